"""Sinks: annotated corpora as text formats. Each gives (doc_id, content), a row a document, to be written by write_documents().

tokens: doc_id, sentence, idx, and the columns that are written. Lines are made by expressions; a document's lines are
put together where its tokens are, after one shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the CoNLL-U format.
CONLLU = ("ID", "FORM", "LEMMA", "UPOS", "XPOS", "FEATS", "HEAD", "DEPREL", "DEPS", "MISC")


def as_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def xml_escaped(value: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def xml_name(name: str) -> str:
    """A name that XML allows: what it does not allow becomes _, and a first character that cannot begin a name gets one before it."""
    shown = re.sub(r"[^\w.\-]", "_", name)
    return shown if re.match(r"[^\W\d]", shown) else f"_{shown}"


def _by_sentence(tokens: DataFrame, line: Column, before: list[Column], after: list[Column], order: str = "sentence", kept: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, content): a line a token between lines of its sentence, which are made of the sentence's columns ``kept``. Tokens are read and shuffled once, by document."""
    kept = tuple(dict.fromkeys(("sentence", *kept)))
    own = tokens.select("doc_id", F.col(order).cast("long").alias("s_order"), F.col("idx").cast("long").alias("t_order"), line.alias("line"), *kept).repartition("doc_id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("t_order", "line"))), lambda x: x["line"])
    sentences = own.groupBy("doc_id", "s_order").agg(lines.alias("lines"), *[F.first(c).alias(c) for c in kept])
    text = F.array_join(F.concat(F.array(*before).cast("array<string>"), F.col("lines"), F.array(*after).cast("array<string>")), "\n")
    every = F.array_sort(F.collect_list(F.struct("s_order", text.alias("text"))))
    return sentences.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(every, lambda x: x["text"]), "\n"), F.lit("\n")).alias("content"))


def csv(tokens: DataFrame, columns: list[str], sentence_attributes: list[str] | None = None, delimiter: str = "\t") -> DataFrame:
    """A header, a line a token, a blank line after each sentence; lines "# sentence.attribute = value" before it."""
    attributes = sentence_attributes or []
    before = [F.concat(F.lit(f"# sentence.{a} = "), as_text(a)) for a in attributes]
    out = _by_sentence(tokens, F.concat_ws(delimiter, *[as_text(c) for c in columns]), before, [F.lit("")], kept=tuple(attributes))
    return out.select("doc_id", F.concat(F.lit(delimiter.join(columns) + "\n"), "content").alias("content"))


def conllu(tokens: DataFrame, fields: dict[str, str | None], sentence_id: str = "sentence") -> DataFrame:
    """CoNLL-U: fields names the token column of each format column; missing ones and empty values are _."""
    values = [F.when(as_text(fields[f]) == "", "_").otherwise(as_text(fields[f])) if fields.get(f) else F.lit("_") for f in CONLLU]
    return _by_sentence(tokens, F.concat_ws("\t", *values), [F.concat(F.lit("# sent_id = "), as_text(sentence_id))], [F.lit("")], kept=(sentence_id,))


def _in_text(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.concat(F.lit('<text id="'), xml_escaped(F.col("doc_id").cast("string")), F.lit('">\n'), "content", F.lit("</text>\n")).alias("content"))


def vrt(tokens: DataFrame, columns: list[str], order: str = "sentence") -> DataFrame:
    """Vertical text: a line a token, columns between tabs, in sentence elements of a text element. order: gives the sentences' order, so that they can be scrambled.

    trees.tree() does so for any annotations.
    """
    cell = lambda c: xml_escaped(F.regexp_replace(as_text(c), r"[\t\n]", " "))
    sentence = F.concat(F.lit('<sentence id="'), F.col("sentence").cast("string"), F.lit('">'))
    return _in_text(_by_sentence(tokens, F.concat_ws("\t", *[cell(c) for c in columns]), [sentence], [F.lit("</sentence>")], order))


def xml_pretty(tokens: DataFrame, columns: list[str], word: str = "word", order: str = "sentence") -> DataFrame:
    """XML with one token element a line; columns become attributes, empty ones are left out. trees.tree() does so for any annotations."""
    attributes = [F.when(as_text(c) != "", F.concat(F.lit(f' {c}="'), xml_escaped(as_text(c)), F.lit('"'))).otherwise("") for c in columns]
    token = F.concat(F.lit("    <token"), *attributes, F.lit(">"), xml_escaped(as_text(word)), F.lit("</token>"))
    sentence = F.concat(F.lit('  <sentence id="'), F.col("sentence").cast("string"), F.lit('">'))
    return _in_text(_by_sentence(tokens, token, [sentence], [F.lit("  </sentence>")], order))


def combined(contents: DataFrame, corpus: str, in_order: bool = False) -> DataFrame:
    """(doc_id, content): the documents of a corpus as one element's parts, in the order of their ids; a row a document, so that no task holds all.

    Write them with write_text(): the first and last rows open and close the corpus. in_order: contents come in the order of their ids as text already, as when the documents were sorted before they were written out, which are smaller.
    """
    edge = lambda key, text: contents.sparkSession.createDataFrame([(key, text)], "part int, content string")
    inner = contents.select(F.lit(1).alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "content")
    if in_order:  # partitions of a union follow each other
        first, last = (edge(0, t).select(F.lit("").alias("doc_id"), "content") for t in (f'<corpus id="{corpus}">\n', "</corpus>\n"))
        return first.unionByName(inner.select("doc_id", "content")).unionByName(last)
    around = edge(0, f'<corpus id="{corpus}">\n').unionByName(edge(2, "</corpus>\n")).withColumn("doc_id", F.lit(""))
    return inner.unionByName(around).orderBy("part", "doc_id").select("doc_id", "content")


def write_documents(contents: DataFrame, path: str, compression: str = "none") -> None:
    """Contents as text files in ``path``, dealt out by document."""
    contents.select(F.regexp_replace("content", "\n$", "").alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def _quoted(name: str, kind: str) -> Column:
    text = F.replace(F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    shown = F.col(name).cast("string") if kind in ("int", "bigint", "double", "boolean") else F.concat(F.lit("'"), text, F.lit("'"))
    return F.coalesce(shown, F.lit("NULL"))


def sql_rows(rows: DataFrame, table: str) -> DataFrame:
    """(statement): an INSERT for each row of a table, values quoted."""
    names = ", ".join(f"`{c}`" for c in rows.columns)
    values = F.concat_ws(", ", *[_quoted(c, k) for c, k in rows.dtypes])
    return rows.select(F.concat(F.lit(f"INSERT INTO `{table}` ({names}) VALUES ("), values, F.lit(");")).alias("statement"))


def sql_inserts(rows: DataFrame, table: str, key: str, rows_a_statement: int = 100) -> DataFrame:
    """(bucket, statement): INSERTs of some ``rows_a_statement`` rows each, dealt by a hash of ``key`` and in its order; no task holds more than one statement's rows."""
    names = ", ".join(f"`{c}`" for c in rows.columns)
    values = F.concat(F.lit("("), F.concat_ws(", ", *[_quoted(c, k) for c, k in rows.dtypes]), F.lit(")"))
    buckets = max(1, -(-rows.count() // rows_a_statement))
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.struct(F.col(key).alias("key"), values.alias("row")).alias("v"))
    together = F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["row"]), ",\n")
    return dealt.groupBy("bucket").agg(F.concat(F.lit(f"INSERT INTO `{table}` ({names}) VALUES\n"), together, F.lit(";")).alias("statement"))


#: Bytes of one statement that database servers take by default.
MOST_BYTES = 900_000


def sql_packets(rows: DataFrame, table: str, key: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(first, n_rows, n_bytes, statement): INSERTs in the order of ``key``, each of as many rows as stay within ``most_bytes``; first is its first key.

    Rows are sorted in ranges of the key, and each range is packed by running bytes while its rows stream by, so no task holds more than one statement and no range is the whole table. A row that is longer by itself is a statement
    of its own. Rows with equal or null keys are packed in the order of their values.
    """
    head, kind = f"INSERT INTO `{table}` ({', '.join(f'`{c}`' for c in rows.columns)}) VALUES\n", rows.schema[key].dataType
    values = F.concat(F.lit("("), F.concat_ws(", ", *[_quoted(c, k) for c, k in rows.dtypes]), F.lit(")"))
    own = rows.select(F.col(key).alias("first"), values.alias("row")).repartitionByRange("first").sortWithinPartitions("first", "row")
    fixed = len(head.encode()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, kind = None, [], fixed, None

        def statement() -> pa.RecordBatch:
            text = head + ",\n".join(held) + ";"
            return pa.RecordBatch.from_arrays([pa.array([first], kind), pa.array([len(held)], pa.int64()), pa.array([len(text.encode())], pa.int64()), pa.array([text])], ["first", "n_rows", "n_bytes", "statement"])

        for batch in batches:
            kind = batch.column("first").type
            for at, row in zip(batch.column("first").to_pylist(), batch.column("row").to_pylist(), strict=True):
                more = len(row.encode()) + 2 * bool(held)
                if held and size + more > most_bytes:
                    yield statement()
                    held, size, more = [], fixed, more - 2
                if not held:
                    first = at
                held.append(row)
                size += more
        if held:
            yield statement()

    return own.mapInArrow(run, f"first {kind.simpleString()}, n_rows long, n_bytes long, statement string")


SQL_TYPES = {"int": "INT", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR(255)", "date": "DATE", "timestamp": "DATETIME"}


def sql_table(rows: DataFrame, table: str, primary: tuple[str, ...] = (), indexes: tuple[str, ...] = (), temporary: str = "temp_") -> dict[str, str]:
    """Statements around the INSERTs: create makes a table with a temporary name, delete clears a corpus' rows, rename puts it in the place of the old one."""
    columns = [f"`{c}` {SQL_TYPES.get(k, 'TEXT')}" for c, k in rows.dtypes]
    columns += [f"PRIMARY KEY ({', '.join(f'`{c}`' for c in primary)})"] * bool(primary) + [f"INDEX `{c}` (`{c}`)" for c in indexes]
    return {
        "create": f"CREATE TABLE `{temporary}{table}` ({', '.join(columns)});",
        "delete": f"DELETE FROM `{table}` WHERE `corpus` = ?;",
        "drop": f"DROP TABLE IF EXISTS `{table}`;",
        "rename": f"RENAME TABLE `{temporary}{table}` TO `{table}`;",
    }


def corpus_info(n_sentences: DataFrame, bounds: DataFrame, resolution: str, protected: bool = False) -> DataFrame:
    """(line): what the index tool is told of a corpus, from one-row tables."""
    n, b = n_sentences.first(), bounds.first()
    lines = [f"Sentences: {n[0]}", f"FirstDate: {b['first']}", f"LastDate: {b['last']}", f"DateResolution: {resolution}", f"Protected: {str(protected).lower()}"]
    return n_sentences.sparkSession.createDataFrame([(x,) for x in lines], "line string")

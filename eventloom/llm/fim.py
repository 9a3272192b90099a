"""Fill-in-middle examples: a document is cut at two hash-random places and told with its middle last.

The work is DuckDB's SQL inside `mapInArrow`: each Arrow slice is registered as a table, cut by regexp_extract_all, put
together by list_slice and array_to_string, and comes back as Arrow. No text becomes a Python object; a very long one is
registered piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import mapped

#: Marks of prefix, suffix and middle; a text that holds one stays plain, so a form can be told apart and undone.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = "[A-Za-z]+|[^A-Za-z]"
#: Of a hundred texts so many are transformed, and of a hundred of these so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: The seed in front of a document's id.
SEED = 1
#: Bytes above which a text is cut in pieces of about so many: lists of tokens take some 40 bytes a byte of text.
LONG, PIECE = 1 << 20, 1 << 18
#: DuckDB's own memory in a worker; it may not spill to a machine-local folder.
MEMORY = "600MB"


def number(place: int) -> str:
    """The 8 hex digits of `hash` at a place, from 0, as a number."""
    return f"CAST('0x' || hash[{8 * place + 1}:{8 * place + 8}] AS BIGINT)"


@dataclass(frozen=True)
class Rule:
    """Which column is the id and which the text of the table `batch`, and how texts are drawn."""

    id: str = "doc_id"
    text: str = "text"
    seed: int = SEED
    transformed: int = TRANSFORMED
    suffix_first: int = SUFFIX_FIRST

    def hashed(self, table: str = "batch") -> str:
        """SQL for the rows of a table with whole, the text, and hash."""
        return f"SELECT *, coalesce({self.text}, '') AS whole, sha256('{self.seed}:' || coalesce(CAST({self.id} AS VARCHAR), '')) AS hash FROM {table}"

    def drawn(self, rows: str) -> str:
        """SQL for rows of whole, hash and n with low and high, the places of the cuts in tokens, and form."""
        marks = " OR ".join(f"contains(whole, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
        return f"""SELECT *, least({number(0)} % (n + 1), {number(1)} % (n + 1)) AS low, greatest({number(0)} % (n + 1), {number(1)} % (n + 1)) AS high,
        CASE WHEN whole = '' OR {marks} OR {number(2)} % 100 >= {self.transformed} THEN 'plain' WHEN {number(3)} % 100 < {self.suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM ({rows})"""

    def parts(self, table: str = "batch") -> str:
        """SQL for the rows of a table with whole, n, form, prefix, middle and suffix."""
        tokens = f"SELECT *, CAST(len(tokens) AS BIGINT) AS n FROM (SELECT *, regexp_extract_all(whole, '{TOKEN}') AS tokens FROM ({self.hashed(table)}))"
        part = lambda first, last: f"array_to_string(list_slice(tokens, {first}, {last}), '')"
        return f"SELECT * EXCLUDE (tokens, low, high), {part(1, 'low')} AS prefix, {part('low + 1', 'high')} AS middle, {part('high + 1', 'n')} AS suffix FROM ({self.drawn(tokens)})"


def told_sql(parts: str) -> str:
    """SQL for rows of parts with their output."""
    return f"""SELECT *, CASE form WHEN 'plain' THEN whole WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
      ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM ({parts})"""


def restored_sql(output: str = "output", form: str = "form") -> str:
    """SQL for the text that an output of a form was made of."""
    part = lambda whole, mark, i: f"string_split({whole}, '{mark}')[{i}]"
    after = lambda mark: part(output, mark, 2)
    psm = f"substr({part(output, SUFFIX, 1)}, {len(PREFIX) + 1}) || {after(MIDDLE)} || {part(after(SUFFIX), MIDDLE, 1)}"
    spm = f"{part(after(PREFIX), MIDDLE, 1)} || {after(MIDDLE)} || substr({part(output, PREFIX, 1)}, {len(SUFFIX) + 1})"
    return f"CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN {psm} ELSE {spm} END"


def pieces(text: pa.StringArray) -> pa.StringArray:
    """A text, the only one of its array, in pieces of about PIECE bytes that begin with a code point that isn't a letter, so
    that none begins inside a token. The pieces share the text's memory."""
    offsets, data = np.frombuffer(text.buffers()[1], np.int32), np.frombuffer(text.buffers()[2], np.uint8)
    start, end = int(offsets[text.offset]), int(offsets[text.offset + 1])
    x = data[start:end]
    letter = ((x | 32) >= ord("a")) & ((x | 32) <= ord("z"))
    breaks = np.flatnonzero(~letter & ((x & 0xC0) != 0x80))
    at = np.searchsorted(breaks, np.arange(PIECE, len(x), PIECE))
    cuts = np.unique(np.concatenate([[0], breaks[at[at < len(breaks)]], [len(x)]]))
    return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer((cuts + start).astype(np.int32).tobytes()), text.buffers()[2])


def long_parts(con: duckdb.DuckDBPyConnection, row: pa.Table, rule: Rule) -> pa.Table:
    """`Rule.parts` of one long text, of whose tokens only a piece's are ever listed."""

    def over(part: pa.Array, what: str) -> pa.Array:
        con.register("piece", pa.table({"x": part}))
        return con.sql(f"SELECT {what} FROM (SELECT *, regexp_extract_all(x, '{TOKEN}') AS tokens FROM piece)").to_arrow_table().column(0).combine_chunks()

    cut = pieces(row.column(rule.text).combine_chunks())
    counts = np.array([over(cut.slice(i, 1), "len(tokens)")[0].as_py() for i in range(len(cut))], np.int64)
    con.register("row", row)
    drawn = con.sql(rule.drawn(f"SELECT *, CAST({counts.sum()} AS BIGINT) AS n FROM ({rule.hashed('row')})")).to_arrow_table()
    upto, offsets = np.concatenate([[0], np.cumsum(counts)]), np.frombuffer(cut.buffers()[1], np.int32)
    places = [int(offsets[0])]
    for name in ("low", "high"):
        token = drawn.column(name)[0].as_py()
        i = min(int(np.searchsorted(upto, token, side="right")) - 1, len(cut) - 1)
        places.append(int(offsets[i]) + over(cut.slice(i, 1), f"strlen(array_to_string(list_slice(tokens, 1, {token - upto[i]}), ''))")[0].as_py())
    made = pa.StringArray.from_buffers(3, pa.py_buffer(np.array([*places, offsets[len(cut)]], np.int32).tobytes()), cut.buffers()[2])
    found = drawn.drop_columns(["low", "high"])
    for i, name in enumerate(("prefix", "middle", "suffix")):
        found = found.append_column(name, made.slice(i, 1))
    return found


def by_duckdb(df: DataFrame, select: str, schema: T.StructType, rule: Rule | None = None) -> DataFrame:
    """The rows of `select` over every Arrow slice of `df`: over the table `batch`, or over what `rule` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False}) as con:
            for part in batches:
                rows = pa.Table.from_batches([part])
                if rule is None:
                    con.register("batch", rows)
                    yield from con.sql(f"{select} FROM batch").to_arrow_table().to_batches()
                    continue
                long = pc.fill_null(pc.greater(pc.binary_length(rows.column(rule.text)), LONG), False)
                con.register("batch", rows.filter(pc.invert(long)))
                yield from con.sql(f"{select} FROM ({told_sql(rule.parts())})").to_arrow_table().to_batches()
                alone = rows.filter(long)
                for i in range(alone.num_rows):
                    con.register("parts", long_parts(con, alone.slice(i, 1), rule))
                    yield from con.sql(f"{select} FROM ({told_sql('parts')})").to_arrow_table().to_batches()

    return mapped(df, run, schema)


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The columns of `docs`, the text replaced by its fill-in-middle output, with n (tokens) and form: plain, psm or spm.

    A null text is the empty one; empty texts and such that hold a mark stay plain. Rows with one id are cut by the same
    hash; a null id hashes as an empty one. Columns named n and form are replaced; others of any name and kind pass
    through untouched. An empty table stays empty. A map stage: texts of any length are cut whole, no shuffle.
    """
    kept = [c for c in docs.columns if c not in (text, "n", "form")]
    # Other columns have places for names, so that none clashes with the SQL's.
    sent = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(id).alias("_id"), F.col(text).alias("_text"))
    columns = ", ".join([*(f"c{i}" for i in range(len(kept))), "output", "n", "form"])
    rule = Rule("_id", "_text", seed, transformed, suffix_first)
    schema = T.StructType([*(T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)), T.StructField("output", T.StringType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())])
    made = by_duckdb(sent, f"SELECT {columns}", schema, rule)
    of = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(kept)} | {text: F.col("output").alias(text)}
    return made.select(*[of[c] for c in docs.columns if c in of], "n", "form")


def restored(examples: DataFrame, text: str = "text") -> DataFrame:
    """`fill_in_middle` undone: the columns but n and form, with the text as it was (a null one empty)."""
    kept = [c for c in examples.columns if c not in (text, "n", "form")]
    sent = examples.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(text).alias("output"), "form")
    schema = T.StructType([*(T.StructField(f"c{i}", examples.schema[c].dataType) for i, c in enumerate(kept)), T.StructField("text", T.StringType())])
    made = by_duckdb(sent, f"SELECT {', '.join([*(f'c{i}' for i in range(len(kept))), f'{restored_sql()} AS text'])}", schema)
    of = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(kept)} | {text: F.col("text").alias(text)}
    return made.select(*[of[c] for c in examples.columns if c in of])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (code points, null if plain), output_sha256, restored_sha256 per row of
    `docs`: `fill_in_middle` and `restored` in one pass, whose texts stay in the worker. Nulls, empty and repeated rows as
    there; other columns are left out."""
    chars = lambda part: f"CASE WHEN form <> 'plain' THEN CAST(length({part}) AS BIGINT) END AS {part}_chars"
    select = f"SELECT doc_id, n, form, {chars('prefix')}, {chars('middle')}, sha256(output) AS output_sha256, sha256({restored_sql()}) AS restored_sha256"
    schema = T.StructType.fromDDL("doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    return by_duckdb(docs.select(F.col("doc_id").cast("long"), "text"), select, schema, Rule())


#: The same columns in another way: from the lengths of the tokens and places in the text; what is restored is the text.
SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('{SEED}:' || doc_id) AS h FROM documents),
u AS (SELECT *, list_transform(regexp_extract_all(x, '{TOKEN}'), lambda w: length(w)) AS sizes, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS k FROM t),
c AS (SELECT *, len(sizes) AS n, CASE WHEN x = '' OR regexp_matches(x, '<[PSM]>') OR k[3] % 100 > 89 THEN 'plain' WHEN k[4] % 100 <= 19 THEN 'spm' ELSE 'psm' END AS form FROM u),
e AS (SELECT *, CAST(coalesce(list_sum(sizes[1 : least(k[1] % (n + 1), k[2] % (n + 1))]), 0) AS BIGINT) AS a, CAST(coalesce(list_sum(sizes[1 : greatest(k[1] % (n + 1), k[2] % (n + 1))]), 0) AS BIGINT) AS b FROM c),
p AS (SELECT *, substr(x, 1, a) AS pre, substr(x, a + 1, b - a) AS mid, substr(x, b + 1) AS post FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || post || '<M>' || mid ELSE '<S>' || post || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM p"""

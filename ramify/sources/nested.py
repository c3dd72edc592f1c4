"""Nested JSON to rows.

Documents in a column are VARIANTs, and one explode per level opens them. All advance
together, so the number of rounds is the depth of the deepest one. Such a document is one
value and has to fit in a row: a VARIANT holds at most 128 MiB, and a larger document
fails in ``parse_json`` with an error that names the limit.

Documents in files may be of any size, see ``read_json_values``: a file is read by many
tasks, and no row holds more than the text between two braces. Names are kept whole;
cutting them is a step of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ramify.functions import text as T
from ramify.operators.hierarchy import rooted_levels
from ramify.operators.ranking import global_rank, grouped_running
from ramify.operators.shared_keys import FEW_KEYS, join_shared
from ramify.store import materialize, transient


def _members(v: Column) -> Column:
    """Members of a VARIANT array, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _fields(v: Column) -> Column:
    """Fields of a VARIANT object, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def flatten_tree_json(docs: DataFrame) -> DataFrame:
    """Nodes of ``docs(doc_id, json)``: (doc_id, path, level, name, child_count).

    A document is ``{name, children: [...]}`` or an array of such nodes. The
    root is named Life; ``path`` holds the positions from the root down. A
    ``children`` that is not an array counts as a list of one; members that are
    no objects are skipped; a missing name becomes Unnamed.
    """

    def children(v: Column) -> Column:
        """Members of ``children`` as an array; null when there are none."""
        kids = F.try_variant_get(v, "$.children", "variant")
        single = F.when(~F.is_variant_null(kids), F.array(kids))
        return F.coalesce(_members(kids), single)

    def is_node(v: Column) -> Column:
        return _fields(v).isNotNull() | _members(v).isNotNull()

    v = F.col("v")
    frontier = docs.select("doc_id", F.parse_json("json").alias("v")).select(
        "doc_id",
        F.array().cast("array<int>").alias("path"),
        F.lit("Life").alias("name"),
        F.coalesce(_members(v), children(v)).alias("kids"),
    )
    levels = []
    while True:
        level = len(levels)
        # Positions are those in the document, so skipped members leave gaps.
        listed = F.when(F.exists("kids", is_node), F.col("kids"))
        table, seen = materialize(
            frontier.withColumn("kids", listed)
            .withColumn("child_count", F.coalesce(F.size(F.filter("kids", is_node)), F.lit(0)).cast("bigint")),
            f"json-{level}",
            {"more": F.count_if(F.col("kids").isNotNull())},
        )
        name = T.unnamed("name").alias("name")
        levels.append(table.select("doc_id", "path", F.lit(level).alias("level"), name, "child_count"))
        if not seen["more"]:
            break
        frontier = (
            table.select("doc_id", "path", F.posexplode("kids").alias("pos", "v"))
            .filter(is_node(v))
            .select(
                "doc_id",
                F.concat("path", F.array("pos")).alias("path"),
                F.try_variant_get("v", "$.name", "string").alias("name"),
                children(v).alias("kids"),
            )
        )
    return reduce(DataFrame.unionByName, levels)


def number_nodes(flat: DataFrame) -> DataFrame:
    """Node table (id, parent_id, name, level) of flattened documents, ids in preorder."""
    ranked = global_rank(flat, ["doc_id", "path"], "id")
    up = F.when(F.col("level") > 0, F.slice("path", F.lit(1), F.size("path") - 1))
    parents = ranked.select(F.col("doc_id").alias("_doc"), F.col("path").alias("_path"), F.col("id").alias("parent_id"))
    child = ranked.withColumn("_up", up)
    return child.join(
        parents, (child["doc_id"] == parents["_doc"]) & (child["_up"] == parents["_path"]), "left"
    ).select("id", "parent_id", "name", "level", "doc_id")


def key_map_rows(docs: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Every key of nested maps: (doc, path ARRAY<STRING>, kind).

    ``kind`` is object, array or scalar. Members of an array are keyed "0", "1", ...
    """
    v = F.col("v")
    frontier = docs.select(doc_col, F.array().cast("array<string>").alias("path"), F.parse_json("json").alias("v"))
    levels = []
    while True:
        # An array is a map from positions to its members.
        listed = _members(v)
        by_position = F.map_from_arrays(
            F.transform(F.sequence(F.lit(0), F.size(listed) - 1), lambda i: i.cast("string")), listed
        )
        shaped = frontier.select(
            doc_col,
            "path",
            F.coalesce(_fields(v), F.when(F.size(listed) > 0, by_position)).alias("below"),
            F.when(_fields(v).isNotNull(), "object").when(listed.isNotNull(), "array").otherwise("scalar").alias("kind"),
        )
        table, seen = materialize(shaped, f"map-{len(levels)}", {"open": F.count_if(F.size("below") > 0)})
        levels.append(table.select(doc_col, "path", "kind"))
        if not seen["open"]:
            break
        frontier = table.select(doc_col, "path", F.explode("below").alias("key", "v")).select(
            doc_col, F.concat("path", F.array("key")).alias("path"), "v"
        )
    return reduce(DataFrame.unionByName, levels).filter(F.size("path") > 0)


def flatten_key_map(docs: DataFrame) -> DataFrame:
    """Paths of ``docs(doc_id, json)`` maps: (doc_id, path, name, level, is_leaf)."""
    rows = key_map_rows(docs)
    parents = rows.filter(F.size("path") > 1).select(
        "doc_id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.lit(False).alias("is_leaf")
    ).distinct()
    return rows.join(parents, ["doc_id", "path"], "left").select(
        "doc_id",
        "path",
        F.element_at("path", -1).alias("name"),
        F.size("path").alias("level"),
        F.coalesce("is_leaf", F.lit(True)).alias("is_leaf"),
    )


def merge_key_maps(parts: DataFrame) -> DataFrame:
    """Paths of the deep merge of ``parts(part_no, json)`` in part order: (path, is_leaf).

    Two objects unite. A scalar or array replaces what earlier parts wrote at
    and below its path; an object replaces a scalar or array; an empty object
    leaves an object as it is.
    """
    rows = materialize(key_map_rows(parts, "part_no"), "merge-rows")
    at_path = rows.groupBy("path").agg(
        F.max(F.when(F.col("kind") != "object", F.col("part_no"))).alias("last_value"),
        F.max("part_no").alias("last_any"),
    )
    # Few paths are ever overwritten; the copy lets adaptive execution split hot ones.
    resets = materialize(at_path.filter("last_value is not null"), "merge-resets")
    arrays = rows.filter("kind = 'array'").select("path", "part_no").join(resets, "path").filter("last_any > part_no")
    above = rows.select(
        "path", "part_no",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("_up"),
    )
    by_value = (
        above.join(resets.select(F.col("path").alias("_up"), "last_value"), "_up")
        .filter("last_value > part_no")
        .select("path", "part_no")
    )
    by_array = (
        above.filter("size(_up) < size(path)")
        .join(arrays.select(F.col("path").alias("_up"), "part_no"), ["_up", "part_no"])
        .select("path", "part_no")
    )
    gone = by_value.unionByName(by_array).distinct()
    kept = rows.select("path", "part_no").join(gone, ["path", "part_no"], "left_anti").select("path").distinct()
    parents = kept.filter(F.size("path") > 1).select(
        F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.lit(False).alias("is_leaf")
    ).distinct()
    return kept.join(parents, "path", "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(True)))


# --- documents larger than a row ------------------------------------------------------

# The last string of a text may go on behind it.
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|[{}\[\]:,]|[^\s"{}\[\]:,]+', re.S)
_ESCAPED = re.compile(r"\\.", re.S)
_DEPTHS = 1 << 31  # more than a document has; block number times this plus a depth is a key
_PARSED = pa.schema([
    ("_b", pa.int64()), ("_nr", pa.int64()), ("depth", pa.int32()), ("_back", pa.int64()), ("key", pa.string()), ("kind", pa.string()), ("text", pa.string()),
    ("_node", pa.int64()), ("_node_up", pa.int64()), ("_hops", pa.int32()), ("_seg", pa.int32()), ("_name", pa.string()), ("_late", pa.bool_()),
])
_PARSED_SQL = (
    "_b bigint, _nr bigint, depth int, _back bigint, key string, kind string, text string, "
    "_node bigint, _node_up bigint, _hops int, _seg int, _name string, _late boolean"
)


def _runs(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[tuple, list[str]]]:
    """Stretches of a batch in which the columns after the first, the text, stay the same."""
    if not batch.num_rows:
        return
    ids = [c.dictionary_encode().indices.to_numpy() for c in batch.columns[1 : columns + 1]]
    cuts = sorted({0, batch.num_rows}.union(*((np.flatnonzero(np.diff(i)) + 1).tolist() for i in ids)))
    for start, end in zip(cuts, cuts[1:]):
        yield tuple(c[start].as_py() for c in batch.columns[1:]), batch.column(0).slice(start, end - start).to_pylist()


def _opened(parts: list[str]) -> int:
    """By how much texts between strings open more than they close."""
    text = "".join(parts)
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: whether its quotes are odd, and what it opens if it begins outside or inside a string."""
    at, odd, outside, inside = None, 0, 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"_file": at[0], "_block": at[1], "_odd": odd, "_outside": outside, "_inside": inside}])

    for batch in batches:
        for key, texts in _runs(batch, 2):
            if key != at:
                if at is not None:
                    yield row()
                at, odd, outside, inside = key, 0, 0, 0
            text = "{".join([*texts, ""])
            parts = (_ESCAPED.sub("", text) if "\\" in text else text).split('"')
            even, rest = _opened(parts[::2]), _opened(parts[1::2])
            outside, inside = (outside + rest, inside + even) if odd else (outside + even, inside + rest)
            odd ^= len(parts) % 2 == 0
    if at is not None:
        yield row()


class _Block:
    """Values that begin in a block, read from its pieces in turn.

    ``_nr`` numbers the values of the block and ``_back`` is by how much the number of the
    container is less, null where that began in an earlier block or there is none. Such a
    container is known by its depth; while it is the innermost of its kind, values belong
    to the segment ``_seg`` (-1 outside all documents). ``_node`` numbers the nodes of a
    tree in a segment, ``_node_up`` is the parent's number, and ``_hops`` counts nodes up
    to the segment's container. ``_name`` is the first name of an object, unless it comes
    after the rows that were handed on: then it is ``_late``.
    """

    def __init__(self, number: int, depth: int, key: str | None = None):
        self.number, self.depth, self.key = number, depth, key
        self.stack, self.nr, self.nodes, self.seg = [], 0, 0, None
        self.carry, self.handed = "", 0
        self.rows, self.names = [], {}

    def feed(self, text: str) -> None:
        tokens = _TOKEN.findall(self.carry + text)
        self.carry = ""
        if tokens and tokens[-1][0] == '"':
            plain = _ESCAPED.sub("", tokens[-1])
            if len(plain) == 1 or plain[-1] != '"':
                self.carry = tokens.pop()
        depth, key, nr, stack, rows = self.depth, self.key, self.nr, self.stack, self.rows
        for token, after in zip(tokens, [*tokens[1:], ""]):
            first = token[0]
            if first in ",:":
                continue
            if first in "]}":
                depth, key = depth - 1, None
                if stack:
                    stack.pop()
                continue
            top = stack[-1] if stack else None
            if first in "[{":
                kind = "array" if first == "[" else "object"
                nr += 1
                # A node's number in the segment, its parent's, hops, segment, the parent's value number.
                node = None
                if top is None:
                    if depth == 0 or depth > 0 and (key is None or key == "children" and kind == "object"):
                        node = (None, 1, depth - 1, None)
                elif key is None and top[2] == "array":
                    if top[1] == 0:
                        node = self._below(top)
                    elif top[3] == "children":
                        node = self._below(stack[-2]) if len(stack) > 1 else (None, 1, top[1] - 1, None)
                elif key == "children" and kind == "object":
                    node = self._below(top)
                number, node_up, hops, seg, above = None, None, None, None, None
                if node is not None:
                    node_up, hops, seg, above = node
                    if seg != self.seg:
                        self.seg, self.nodes = seg, 0
                    self.nodes = number = self.nodes + 1
                back = None if top is None else nr - top[0]
                stack.append([nr, depth, kind, key, number, hops, seg, self.handed + len(rows), False, above, back])
                rows.append((nr, depth, back, key, kind, None, number, node_up, hops, seg, False))
                depth, key = depth + 1, None
            elif first == '"' and after == ":":
                key = json.loads(token, strict=False) if "\\" in token else token[1:-1]
            else:
                if first == '"':
                    kind, text = "scalar", json.loads(token, strict=False) if "\\" in token else token[1:-1]
                else:
                    kind, text = ("scalar", token) if token != "null" else ("null", None)
                nr += 1
                late = False
                if key == "name" and kind == "scalar":
                    if top is None:
                        late = True
                    elif not top[8]:
                        top[8] = True
                        if top[7] >= self.handed:
                            self.names[top[7] - self.handed] = text
                        else:
                            late = True
                rows.append((nr, depth, None if top is None else nr - top[0], key, kind, text, None, None, None, None, late))
                key = None
        self.depth, self.key, self.nr = depth, key, nr

    @staticmethod
    def _below(parent: list) -> tuple | None:
        return None if parent[4] is None else (parent[4], parent[5] + 1, parent[6], parent[0])

    def take(self) -> pa.RecordBatch:
        """Rows found since the last call."""
        rows, names = self.rows, self.names
        columns = [*zip(*rows)] if rows else [()] * 11
        columns = [[self.number] * len(rows), *columns[:10], [names.get(i) for i in range(len(rows))] if names else [None] * len(rows), columns[10]]
        self.handed += len(rows)
        self.rows, self.names = [], {}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PARSED.types)], schema=_PARSED)

    def end(self, last: bool, begun: bool) -> Iterator[pa.RecordBatch]:
        """The rest of the rows, the containers still open, and the string that goes on in the next block."""
        if not last and begun:
            self.feed("{")
        elif self.carry:
            text, self.carry = self.carry[1:], ""
            self.feed(text)
        yield self.take()
        # The node above an open container is open too, and given by its value number.
        more = [(nr, d, back, key, "open", kind, node, above, hops, seg, False) for nr, d, kind, key, node, hops, seg, _, _, above, back in self.stack]
        if self.carry:
            more.append((None, self.depth, None, self.key, "cut", self.carry, None, None, None, None, False))
        self.rows = more
        yield self.take()


def _mark(block: _Block, kind: str, text: str) -> pa.RecordBatch:
    """A row that is no value: text that a block leaves to others."""
    block.rows.append((None, block.depth, None, block.key, kind, text, None, None, None, None, False))
    return block.take()


def _block_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_Block`` for pieces with number, depth and string state of their block, and whether it ends the file.

    Pieces up to the end of a string that an earlier block began go on as kind head.
    """
    at, block, head, closed, begun = None, None, [], True, False

    def headed(more: bool) -> Iterator[pa.RecordBatch]:
        """The head is whole: it ends at a brace if pieces come after it."""
        text = "{".join([*head, ""] if more else head)
        head.clear()
        block.depth += _opened(_ESCAPED.sub("", text).split('"')[1::2])
        yield _mark(block, "head", text)

    def ended() -> Iterator[pa.RecordBatch]:
        if head:
            yield from headed(not at[3])
        if closed:
            yield from block.end(at[3], begun)

    for batch in batches:
        for key, texts in _runs(batch, 1):
            if key != at:
                if at is not None:
                    yield from ended()
                at, block, closed, begun = key, _Block(key[0], key[1]), not key[2], False
            while texts and not closed:
                head.append(texts.pop(0))
                closed = _ESCAPED.sub("", head[-1] + "{").count('"') % 2 == 1
            if texts:
                if head:
                    yield from headed(True)
                block.feed("{".join(["", *texts] if begun else texts))
                begun = True
                yield block.take()
    if at is not None:
        yield from ended()


def _cut_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_Block`` for texts that blocks cut inside a string: (text, number, depth, key)."""
    for batch in batches:
        for row in batch.to_pylist():
            block = _Block(row["_b"], row["depth"], row["key"])
            block.feed(row["text"])
            yield from block.end(True, True)


class _Parsed(NamedTuple):
    values: DataFrame  # of all blocks, as _Block has them
    opened: DataFrame  # containers open at the end of their block, with their id
    before: DataFrame  # _b and the number of values before it: a row per block
    outer: DataFrame  # _b, _at and the container of depth _at that is open when _b begins


def _parse(spark: SparkSession, path: str) -> _Parsed:
    """The JSON files under ``path``, block by block, without moving their text.

    Files are read as text that ends at opening braces, so that Spark cuts them into
    ranges of bytes, the blocks. Whether a block begins inside a string is the parity of
    the quotes before it, and its depth a sum over the blocks before. A task then reads a
    block with a stack; only members of containers that an earlier block began need a
    lookup. Values of a piece that a block cuts inside a string make up a block of their own.
    """
    texts = spark.read.option("lineSep", "{").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    sums = materialize(texts.mapInArrow(_block_sums, "_file string, _block bigint, _odd bigint, _outside bigint, _inside bigint"), "json-sums")
    in_file = Window.partitionBy("_file").orderBy("_block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(
        sums.withColumn("_in", F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2 == 1)
        .withColumn("_last", F.lead("_block").over(in_file).isNull())
        # The sums count a brace after every piece; the last of a file has none.
        .withColumn("_none", (F.col("_last") & (F.col("_in") == (F.col("_odd") == 1))).cast("int"))
        .withColumn("_opens", F.when(F.col("_in"), F.col("_inside")).otherwise(F.col("_outside")) - F.col("_none"))
        .withColumn("_depth", F.coalesce(F.sum("_opens").over(earlier), F.lit(0)))
        .withColumn("_b", F.row_number().over(Window.orderBy("_file", "_block")).cast("bigint") * 2)
        .select("_file", "_block", "_b", "_depth", "_in", "_last", "_opens"),
        "json-blocks",
    )
    unbalanced = blocks.groupBy("_file").agg(F.sum("_opens").alias("n")).filter("n <> 0").first()
    if unbalanced:
        raise ValueError(f"braces or brackets are not balanced: {unbalanced['_file']}")
    pieces = texts.join(F.broadcast(blocks), ["_file", "_block"]).select("value", "_b", "_depth", "_in", "_last")
    parsed, seen = materialize(pieces.mapInArrow(_block_values, _PARSED_SQL), "json-parsed", {"cuts": F.count_if(F.col("kind") == "cut")})
    if seen["cuts"]:
        cut = F.col("kind") == "cut"
        strings = parsed.filter(F.col("kind").isin("cut", "head")).select("_b", "kind", "text", "depth", "key")
        strings = strings.withColumn("_string", F.count_if(cut).over(Window.orderBy("_b", cut).rowsBetween(Window.unboundedPreceding, 0)))
        in_turn = F.array_sort(F.collect_list(F.struct("_b", "text")))
        joined = strings.groupBy("_string").agg(
            F.array_join(F.transform(in_turn, lambda x: x["text"]), "").alias("text"),
            (F.min("_b") + 1).alias("_b"), F.min_by("depth", "_b").alias("depth"), F.min_by("key", "_b").alias("key"),
        )
        parsed = parsed.unionByName(materialize(joined.drop("_string").mapInArrow(_cut_values, _PARSED_SQL), "json-cut"))
    numbers = parsed.groupBy("_b").agg(F.max("_nr").alias("_n"))
    before = materialize(numbers.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")), "json-before")
    values = parsed.filter(~F.col("kind").isin("open", "head", "cut"))
    opened = materialize(
        parsed.filter("kind = 'open'").join(F.broadcast(before), "_b").select(
            "_b", "depth", "key", F.col("text").alias("kind"), (F.col("_before") + F.col("_nr")).alias("id"),
            "_node", (F.col("_before") + F.col("_node_up")).alias("_above"), "_hops", "_seg",
        ),
        "json-open",
    )
    asked = values.filter("_back is null and depth > 0").select("_b", (F.col("depth") - 1).alias("_at")).distinct()
    asked = asked.unionByName(asked.filter("_at > 0").withColumn("_at", F.col("_at") - 1)).distinct()
    # The last container of a depth that began before. A depth has two rows of a block at most.
    begun = opened.select("_b", F.col("depth").alias("_at"), F.lit(1).alias("_begins"), F.struct("id", "key", "kind").alias("_c"))
    in_turn = Window.partitionBy("_at").orderBy("_b", "_begins").rowsBetween(Window.unboundedPreceding, 0)
    outer = materialize(
        asked.withColumn("_begins", F.lit(0)).unionByName(begun, allowMissingColumns=True)
        .withColumn("_c", F.last("_c", ignorenulls=True).over(in_turn))
        .filter("_begins = 0").select("_b", "_at", "_c.id", "_c.key", "_c.kind"),
        "json-outer",
    )
    return _Parsed(values, opened, before, outer)


def _place(block: str, depth: Column) -> Column:
    return F.col(block) * F.lit(_DEPTHS) + depth


def _members_of(parsed: _Parsed, values: DataFrame) -> DataFrame:
    """``values`` with id and parent_id."""
    far = F.when(F.col("_back").isNull() & (F.col("depth") > 0), _place("_b", F.col("depth") - 1))
    rows = values.join(F.broadcast(parsed.before), "_b").withColumn("id", F.col("_before") + F.col("_nr")).withColumn("_far", far)
    outer = parsed.outer.select(_place("_b", F.col("_at")).alias("_far"), F.col("id").alias("_outer"))
    return join_shared(rows, outer, "_far").withColumn("parent_id", F.coalesce(F.col("id") - F.col("_back"), F.col("_outer")))


def read_json_values(spark: SparkSession, path: str) -> DataFrame:
    """Every value of the JSON files under ``path``: (id, parent_id, depth, key, kind, text).

    A file holds one document or several, one after another, each of any size. ``id``
    numbers the values in the order of the text from 1, files in the order of their names;
    ``key`` is null for a member of an array and a document itself, at depth 0. ``kind`` is
    object, array, scalar or null; a scalar has its text. Raises when braces and brackets
    are not balanced.
    """
    with transient(spark):
        parsed = _parse(spark, path)
        values = _members_of(parsed, parsed.values)
        return materialize(values.select("id", "parent_id", "depth", "key", "kind", "text"), "json-tree", keep=True)


def _segments(parsed: _Parsed, nodes: DataFrame) -> DataFrame:
    """Segments whose container can have nodes below it: (_place, _first, _up, _level).

    ``_first`` is the number of nodes before the segment; ``_up`` and ``_level`` are number
    and level of the node that holds those of the segment. Only containers open at the end
    of a block matter here, and what holds one of them is one of them.
    """
    segments = materialize(nodes.groupBy("_b", "_seg").agg(F.max("_node").alias("_n")), "json-segments")
    above = parsed.outer.select("_b", (F.col("_at") + 1).alias("_at"), F.col("id").alias("_above_id"))
    holder = F.when((F.col("kind") == "object") | (F.col("_at") == 0), F.col("id")).when(F.col("key") == "children", F.col("_above_id"))
    holders = parsed.outer.join(above, ["_b", "_at"], "left").select("_b", F.col("_at").alias("_seg"), holder.alias("_holder"))
    holders = materialize(holders, "json-holders")
    # A node that is missing stands for a container without nodes.
    up = F.coalesce("_above", F.when(F.col("_seg") >= 0, F.coalesce("_holder", F.lit(-1))))
    inner = parsed.opened.filter("_node is not null").join(holders, ["_b", "_seg"], "left").select("id", up.alias("parent_id"), "_b", "_seg", "_node")
    inner, seen = materialize(inner, "json-inner", {"n": F.count(F.lit(1))})
    found = segments.filter("_seg < 0").select("*", F.lit(-1).alias("_level"), *[F.lit(None).cast("bigint").alias(c) for c in ("_in", "_in_seg", "_in_node")])
    if seen["n"]:
        levels = rooted_levels(inner, roots="many").select("id", F.col("level").alias("_level"))
        known = inner.join(levels, "id").select(
            F.col("id").alias("_holder"), "_level", F.col("_b").alias("_in"), F.col("_seg").cast("bigint").alias("_in_seg"), F.col("_node").alias("_in_node")
        )
        found = found.unionByName(segments.join(holders, ["_b", "_seg"]).join(known, "_holder").drop("_holder"))
    found = materialize(found, "json-found")
    per_block = found.groupBy("_b").agg(F.sum("_n").alias("_n"))
    before = per_block.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # A block leaves the innermost of the containers it began in first.
    in_turn = Window.partitionBy("_b").orderBy(F.col("_seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = found.withColumn("_first", F.coalesce(F.sum("_n").over(in_turn), F.lit(0))).join(F.broadcast(before), "_b").withColumn("_first", F.col("_first") + F.col("_before"))
    first = materialize(first, "json-first")
    at = first.select(F.col("_b").alias("_in"), F.col("_seg").cast("bigint").alias("_in_seg"), F.col("_first").alias("_in_first"))
    return materialize(
        first.join(at, ["_in", "_in_seg"], "left").select(
            _place("_b", F.col("_seg") + 1).alias("_place"), "_first", (F.col("_in_first") + F.col("_in_node")).alias("_up"), "_level"
        ),
        "json-places",
    )


def read_tree_json(spark: SparkSession, path: str) -> DataFrame:
    """Node table (id, parent_id, name, level) of tree documents of any size, ids in preorder.

    What is a node, and its name, is as in ``flatten_tree_json``. Numbers and levels are
    counted while a block is read; a row per segment of a block places them in the whole.
    """
    with transient(spark):
        parsed = _parse(spark, path)
        nodes = parsed.values.filter(F.col("_node").isNotNull()).select("_b", "_nr", "_seg", "_node", "_node_up", "_hops", "_name")
        segments = _segments(parsed, nodes)
        late = _members_of(parsed, parsed.values.filter("_late")).groupBy("parent_id").agg(F.min_by("text", "id").alias("_late_name"))
        late, seen = materialize(late, "json-names", {"n": F.count(F.lit(1))})
        if seen["n"]:
            late = late.select(F.col("parent_id").alias("_id"), "_late_name")
            numbered = nodes.join(F.broadcast(parsed.before), "_b").withColumn("_id", F.col("_before") + F.col("_nr"))
            named = numbered.join(F.broadcast(late) if seen["n"] <= FEW_KEYS else late, "_id", "left")
            nodes = named.withColumn("_name", F.coalesce("_name", "_late_name"))
        nodes = nodes.select(_place("_b", F.col("_seg") + 1).alias("_place"), "_node", "_node_up", "_hops", "_name")
        placed = join_shared(nodes, segments, "_place", "inner").withColumn("level", (F.col("_level") + F.col("_hops")).cast("int"))
        name = F.when(F.col("level") == 0, F.lit("Life")).otherwise(F.col("_name"))
        return materialize(
            placed.select(
                (F.col("_first") + F.col("_node")).alias("id"), F.coalesce(F.col("_first") + F.col("_node_up"), F.col("_up")).alias("parent_id"),
                T.unnamed(name).alias("name"), "level",
            ),
            "json-nodes", keep=True,
        )


def read_key_map(spark: SparkSession, path: str) -> DataFrame:
    """Keys of map documents of any size: (id, parent_id, name, level, is_leaf), as in ``flatten_key_map``.

    Members of an array are named by their position. Keys of level 1 have no parent.
    """
    values = read_json_values(spark, path)
    members = grouped_running(values.filter("key is null and depth > 0"), ["parent_id"], ["id"], "_nr")
    positions = members.select("id", (F.col("_nr") - 1).cast("string").alias("_position"))
    holders = values.filter("parent_id is not null").select(F.col("parent_id").alias("id"), F.lit(False).alias("is_leaf")).distinct()
    return (
        values.filter("depth > 0").join(positions, "id", "left").join(holders, "id", "left")
        .select(
            "id", F.when(F.col("depth") > 1, F.col("parent_id")).alias("parent_id"), F.coalesce("key", "_position").alias("name"),
            F.col("depth").alias("level"), F.coalesce("is_leaf", F.lit(True)).alias("is_leaf"),
        )
    )

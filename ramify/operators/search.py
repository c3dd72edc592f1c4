"""Name search, path lookup and enrichment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramify.functions.relevance import is_subsequence, path_bonus, relevance, relevance_to
from ramify.operators.hierarchy import PATH_HASH, path_term
from ramify.operators.ranking import grouped_running, top_k
from ramify.store import materialize

EXACT = 1000.0


def _matches(labelled: DataFrame, queries: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(query, node columns, base) for every match of every query, in one scan.

    The queries are literals, like the conditions of a WHERE clause. A row is
    tested against each and only the matches are emitted and scored.
    """
    wanted = list(dict.fromkeys(q.strip() for q in queries if q and q.strip()))
    if not wanted:
        return labelled.select(F.lit("").alias("query"), F.lit(0.0).alias("base"), F.lit(0.0).alias("bonus"), *keep).limit(0)
    name, level = F.col("name"), F.col("level")
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    is_subsequence(name, q),
                    F.struct(
                        F.lit(q).alias("query"),
                        relevance(name, q, F.col("child_count"), level).alias("base"),
                        path_bonus(F.col("path_names"), q).alias("bonus"),
                    ),
                )
                for q in wanted
            ]
        )
    )
    return (
        labelled.select(*keep, F.explode(hits).alias("_hit"))
        .select("_hit.query", "_hit.base", "_hit.bonus", *keep)
        .filter("base > 0")
    )


def search(labelled: DataFrame, queries: Sequence[str], limit: int | None = None) -> DataFrame:
    """Every match of each query, best first: (query, rank, id, name, score).

    Score of the name plus the path bonus, ties by name and id; blank queries find
    nothing. With ``limit`` only so many per query are returned.
    """
    scored = _matches(labelled, queries, ["id", "name", "path_names"]).withColumn("score", F.col("base") + F.col("bonus"))
    order = [F.col("score").desc(), "name", "id"]
    if limit is None:
        ranked = grouped_running(scored, ["query"], order, "rank")
    else:
        ranked = top_k(scored, ["query"], order, limit, "rank", "id")
    return ranked.select("query", F.col("rank").cast("bigint").alias("rank"), "id", "name", "score", "path_names")


def search_terms(labelled: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """``search`` for a table of any number of ``queries(query)``: (query, rank, id, name, score).

    An index of subsequences: a name holds a pair of characters if one stands somewhere
    before the other. A query meets the names under the rarest of its own pairs (its only
    character, if it has one), an equi-join; only names that hold that pair are compared
    and scored, in one scan each.
    """
    asked = queries.select(F.trim("query").alias("query")).filter(F.length("query") > 0).distinct()
    wanted = materialize(asked.select("query", F.explode(_pairs(F.lower("query"), F.length("query") == 1)).alias("piece")), "query-pieces")
    sizes = [r["n"] for r in wanted.select(F.length("piece").alias("n")).distinct().collect()]  # 1 and 2 at most
    lower = F.lower("name")
    held = reduce(DataFrame.unionByName, [labelled.select("id", F.explode(_pairs(lower, F.lit(n == 1))).alias("piece")) for n in sizes or [2]])
    pieces = materialize(wanted.select("piece").distinct(), "pieces")
    common = materialize(held.join(pieces, "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    # A query with a piece that no name holds has no match.
    chosen = materialize(
        wanted.join(common, "piece", "left").groupBy("query")
        .agg(F.min_by("piece", F.struct("_n", "piece")).alias("piece"), F.min(F.coalesce("_n", F.lit(0))).alias("_n"))
        .filter("_n > 0").select("query", "piece"),
        "chosen",
    )
    names = materialize(held.join(chosen.select("piece").distinct(), "piece", "left_semi"), "name-pieces")
    scored = (
        chosen.join(names, "piece").select("query", "id")
        .join(labelled.select("id", "name", "path_names", "child_count", "level"), "id")
        .withColumn("base", relevance_to(F.col("name"), F.col("query"), F.col("child_count"), F.col("level")))
        .filter("base > 0")
        .select("query", "id", "name", (F.col("base") + path_bonus(F.col("path_names"), F.col("query"))).alias("score"))
    )
    order = [F.col("score").desc(), "name", "id"]
    ranked = grouped_running(scored, ["query"], order, "rank") if limit is None else top_k(scored, ["query"], order, limit, "rank", "id")
    return ranked.select("query", F.col("rank").cast("bigint").alias("rank"), "id", "name", "score")


def _pairs(text: Column, single: Column) -> Column:
    """The distinct pairs of a character and one that stands after it; single characters on request.

    What follows the first place of a character follows any of its places.
    """
    letters = F.array_distinct(F.split(text, ""))
    after = F.transform(
        letters, lambda c: F.transform(F.array_distinct(F.split(F.substr(text, F.position(c, text) + 1), "")), lambda d: F.concat(c, d))
    )
    return F.when(single, letters).otherwise(F.filter(F.array_distinct(F.flatten(after)), lambda p: F.length(p) == 2))


def search_first_candidates(labelled: DataFrame, queries: Sequence[str], limit: int, candidates: int) -> DataFrame:
    """Order-dependent top ``limit``: only the first ``candidates`` of a fixed walk compete.

    The walk is a preorder that takes the last child first. Exact hits get no path bonus; without an
    exact hit the first 2 * limit candidates get one, otherwise the first
    2 * limit of the others. If exact hits alone fill the limit, only they count.
    """
    # Before a node in that walk: its ancestors and all subtrees right of its path.
    walk = F.col("level") - F.col("pre_end")
    found = _matches(labelled, queries, ["id", "name", "level", "pre_end"])
    first = top_k(found.withColumn("_walk", walk), ["query"], ["_walk"], candidates, "_seen", "id")
    exact = F.col("base") >= EXACT
    # At most ``candidates`` rows per query from here on.
    per_query = Window.partitionBy("query")
    in_turn = per_query.orderBy("_seen").rowsBetween(Window.unboundedPreceding, 0)
    counted = first.withColumn("_exact", F.sum(exact.cast("int")).over(per_query)).withColumn(
        "_turn", F.sum((~exact).cast("int")).over(in_turn)
    )
    score = F.when(exact | (F.col("_turn") > 2 * limit), F.col("base")).otherwise(F.col("base") + F.col("bonus"))
    competing = counted.filter(exact | (F.col("_exact") < limit)).withColumn("score", score)
    ranked = top_k(competing, ["query"], [F.col("score").desc(), "name", "id"], limit, "rank", "id")
    return ranked.select("query", "rank", "id", "name", "score")


def search_results(found: DataFrame) -> DataFrame:
    """Result rows with the parent path joined by ' / '."""
    parent = F.slice("path_names", F.lit(1), F.size("path_names") - 1)
    return found.select("query", "rank", "id", "name", F.array_join(parent, " / ").alias("path"))


def resolve_paths(labelled: DataFrame, requests: DataFrame) -> DataFrame:
    """Deepest node reached by each (path_no, path): ``id``, ``name``, ``matched``.

    Splits at '/', drops empty parts and a leading root name, descends by exact
    name, takes the first child of several with that name and stops at the
    first miss; an empty path gives the root. Expects a tree with one root.

    The hash of a path is a sum over its steps, on both sides. One equi-join on level and
    hash finds the first node in preorder at every prefix of a request; a walk goes
    through these nodes or ends. Names and parents of the hits are compared, so that a
    hash decides nothing by itself.
    """
    root = labelled.filter(F.col("level") == 0).select("id", "name").first()
    root_name = root["name"]
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    parts = F.when(F.get(parts, F.lit(0)) == root_name, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    whole = F.concat(F.array(F.lit(root_name).cast("string")), F.coalesce(parts, F.array().cast("array<string>")))
    # One request is one walk: its steps stand together.
    walk = Window.partitionBy("path_no").orderBy("level")
    steps = requests.select("path_no", F.posexplode(whole).alias("level", "name"))
    steps = materialize(steps.select("*", *[F.sum(path_term(i)).over(walk).alias(c) for i, c in enumerate(PATH_HASH)]), "path-steps")
    key = ["level", *PATH_HASH]
    # A copy, so that adaptive execution can split a path shared by many nodes.
    wanted = materialize(steps.select(*key).distinct(), "path-keys")
    first = (
        labelled.select("id", "parent_id", "name", "pre", *key).join(wanted, key, "left_semi")
        .groupBy(*key).agg(F.min_by(F.struct("id", "parent_id", "name"), "pre").alias("hit"))
    )
    above = F.lag("hit.id").over(walk)
    fits = (F.col("name") == F.col("hit.name")) & ((F.col("level") == 0) | (F.col("hit.parent_id") == above))
    met = steps.join(first, key, "left").withColumn("_fits", F.coalesce(fits, F.lit(False)))
    miss = F.min(F.when(~F.col("_fits"), F.col("level"))).over(Window.partitionBy("path_no"))
    reached = met.withColumn("_miss", miss).filter((F.col("level") == 0) | F.col("_miss").isNull() | (F.col("level") < F.col("_miss")))
    return (
        reached.groupBy("path_no").agg(F.max_by(F.struct("hit.id", "hit.name", "level"), "level").alias("hit"))
        .select("path_no", F.coalesce("hit.id", F.lit(root["id"])).alias("id"), F.coalesce("hit.name", F.lit(root_name)).alias("name"), F.col("hit.level").alias("matched"))
    )


def enrich_nodes(nodes: DataFrame, pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """Thumbnail, extract and caption for nodes, from offline lookup tables.

    ``pages(title, thumbnail, extract, wikibase_item)`` by name (any case),
    then ``ranks(wikibase_item, rank_label)``; the first entry of several
    (by ``title`` and ``rank_label``) counts, and only http(s) thumbnails.
    """
    page = (
        pages.groupBy(F.lower("title").alias("_key"))
        .agg(F.min_by(F.struct("thumbnail", "extract", "wikibase_item"), F.struct("title", "wikibase_item", "thumbnail", "extract")).alias("p"))
        .select("_key", "p.*")
    )
    rank = ranks.groupBy("wikibase_item").agg(F.min("rank_label").alias("rank_label"))
    return (
        nodes.withColumn("_key", F.lower("name"))
        .join(page.join(rank, "wikibase_item", "left"), "_key", "left")
        .withColumn("thumbnail", F.when(F.col("thumbnail").rlike("(?i)^https?://"), F.col("thumbnail")))
        .withColumn(
            "caption",
            F.when(F.col("rank_label").isNotNull(), F.concat("name", F.lit(" ("), "rank_label", F.lit(")"))).otherwise(
                F.col("name")
            ),
        )
        .drop("_key")
    )


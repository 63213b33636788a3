"""Filters, joins, aggregates, pages and set operations over any frame.

Every function takes and returns DataFrames and adds no action; ties are
always broken by an id, so that pages and top-k are the same at each run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.conf import InvalidInput, UnknownColumn


def _known(df: DataFrame, names: Iterable[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise UnknownColumn(f"no such column: {', '.join(missing)}")


def equal_where(df: DataFrame, **filters: object) -> DataFrame:
    """Conjunction of equalities; a value of None asks for nothing."""
    _known(df, filters)
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def by_keys(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Rows whose key is listed; an empty list gives no rows and reads nothing."""
    _known(df, [key])
    return df.where(F.col(key).isin(list(values))) if values else df.limit(0)


def contains_text(column: str, text: str) -> Column:
    """Case-insensitive substring of trimmed text; % and _ keep their LIKE meaning."""
    return F.col(column).ilike(f"%{text.strip()}%")


def equals_folded(column: str, text: str) -> Column:
    return F.lower(F.col(column)) == F.lit(text.strip().lower())


def ordered(df: DataFrame, *order: str, key: str) -> DataFrame:
    """Order by names, a leading - for falling; the key breaks ties."""
    names = [o.lstrip("-") for o in order]
    _known(df, [*names, key])
    cols = [F.col(n).desc() if o.startswith("-") else F.col(n).asc() for o, n in zip(order, names, strict=True)]
    return df.orderBy(*cols, *([] if key in names else [F.col(key).asc()]))


def page(df: DataFrame, *order: str, key: str, skip: int = 0, limit: int = 20) -> DataFrame:
    if skip < 0 or not 1 <= limit <= 100:
        raise InvalidInput("skip must not be negative and limit must be 1 to 100")
    return ordered(df, *order, key=key).offset(skip).limit(limit)


def page_with_total(df: DataFrame, *order: str, key: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """A page with total and has_more. The total is one row of partial counts, joined by broadcast; the page is a top-k."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = page(df, *order, key=key, skip=skip, limit=limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > skip + limit)


def latest_per(df: DataFrame, keys: Sequence[str], newest: str, tie: str) -> DataFrame:
    """The newest row of each key, the highest tie among equals: a grouped maximum, so no sort of a whole key."""
    _known(df, [*keys, newest, tie])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(newest, tie)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def exists(df: DataFrame) -> DataFrame:
    """One row saying whether df has any."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def owned(children: DataFrame, parents: DataFrame, on: str, parent_key: str, **owner: object) -> DataFrame:
    """Children whose parent passes the owner filter."""
    return children.join(equal_where(parents, **owner).select(F.col(parent_key).alias("_p")), F.col(on) == F.col("_p"), "left_semi")


def listing(children: DataFrame, parents: DataFrame, on: str, parent_key: str, owner: str, user: object, parent: object = None, **filters: object) -> DataFrame:
    """A user's children: those of one parent that is the user's, if a parent is asked for, else of all of them; then the filters."""
    mine = equal_where(parents, **{owner: user})
    own = mine if parent is None else mine.where(F.col(parent_key) == F.lit(parent))
    scope = children if parent is None else children.where(F.col(on) == F.lit(parent))  # reaches the scan
    return equal_where(scope.join(own.select(F.col(parent_key).alias("_p")), F.col(on) == F.col("_p"), "left_semi"), **filters)


def orphans(children: DataFrame, parents: DataFrame, on: str, parent_key: str, age: Column | None = None) -> DataFrame:
    """Children without a parent, of a guarded age: all of them."""
    lost = children.join(parents.select(F.col(parent_key).alias("_p")), F.col(on) == F.col("_p"), "left_anti")
    return lost if age is None else lost.where(age)


def orphan_pass(children: DataFrame, parents: DataFrame, on: str, parent_key: str, key: str, age: Column | None = None, most: int = 5000) -> DataFrame:
    """The orphans that one pass removes: the first by key, so many at most. Passes go on until one finds none."""
    return orphans(children, parents, on, parent_key, age).orderBy(key).limit(most)


def without_orphans(children: DataFrame, parents: DataFrame, on: str, parent_key: str, key: str, store: Callable[[DataFrame, int], DataFrame], age: Column | None = None, most: int = 5000) -> tuple[DataFrame, list[int]]:
    """children after passes until nothing is left to remove, and how many rows each pass took.

    store(frame, pass) writes what stays to a place that all executors see and
    reads it again, so that no pass is worked out twice.
    """
    taken: list[int] = []
    while True:
        gone = orphan_pass(children, parents, on, parent_key, key, age, most).select(F.col(key).alias("_gone"))
        n = gone.count()
        if not n:
            return children, taken
        children = store(children.join(gone, F.col(key) == F.col("_gone"), "left_anti"), len(taken))
        taken.append(n)


def status_counts(df: DataFrame, status: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n"))


def status_map(df: DataFrame, status: str, *keys: str) -> DataFrame:
    """One map of counts for each key."""
    return status_counts(df, status, *keys).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(status, "n")))).alias("counts"))


def next_index(df: DataFrame, index: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("next_index"))


def child_stats(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[Column]]]) -> DataFrame:
    """Parents with each child's aggregates; a child is grouped first, so that the join sees one row for each parent."""
    out = parents
    for frame, on, aggregates in children.values():
        small = frame.groupBy(F.col(on).alias("_k")).agg(*aggregates)
        out = out.join(small, F.col(key) == F.col("_k"), "left").drop("_k")
    return out


def latest_score(score: str, at: str, tie: str) -> Column:
    """The newest value that isn't null."""
    return F.max_by(F.col(score), F.when(F.col(score).isNotNull(), F.struct(at, tie)))


def collect_children(df: DataFrame, key: str, order: str, value: str, most: int = 20) -> DataFrame:
    """The newest `most` child values of each key as one text; ranked before they are collected, so a list stays short."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(value).asc()))).where(F.col("_r") <= most)
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", value))), lambda s: s[value].cast("string")), ",").alias("children"))


def access(requests: DataFrame, items: DataFrame, key: str, owner: str, asked_by: str) -> DataFrame:
    """requests with outcome: owned, foreign or missing."""
    known = items.select(F.col(key).alias("_k"), F.col(owner).alias("_o"))
    out = requests.join(known, F.col(key) == F.col("_k"), "left")
    outcome = F.when(F.col("_k").isNull(), "missing").when(F.col("_o") == F.col(asked_by), "owned").otherwise("foreign")
    return out.withColumn("outcome", outcome).drop("_k", "_o")


def conflicts(new: DataFrame, old: DataFrame, *keys: str) -> DataFrame:
    return new.join(old.select(*keys).distinct(), list(keys), "left_semi")


def remaining(limit: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(limit, F.lit(0)) - F.coalesce(used, F.lit(0)))


def fuse_rankings(rankings: DataFrame, ranking: str, item: str, score: str, k: int = 60, most: int = 50) -> DataFrame:
    """Reciprocal-rank fusion of long-form rankings: item, fused (the best one 1.0), in n rankings.

    Of each ranking the first `most` items count, as a search's lists have a
    limit; tasks cut a ranking to them before it is shuffled, so its length
    never meets in one task.
    """
    place = F.row_number().over(Window.partitionBy(ranking).orderBy(F.col(score).desc(), F.col(item)))
    fused = rankings.withColumn("_p", place).where(F.col("_p") <= most).groupBy(item).agg(F.sum(1.0 / (k + F.col("_p"))).alias("_f"), F.count(F.lit(1)).alias("lists"))
    best = fused.agg(F.max("_f").alias("_best"))
    return fused.crossJoin(F.broadcast(best)).select(item, (F.col("_f") / F.col("_best")).alias("fused"), "lists")

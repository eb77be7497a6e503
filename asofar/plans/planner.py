"""Compiles features and a request table into one DataFrame plan.

Leaves that share source, keys, category and schedule share one pass of tiles, and plain aggregates of all windows one sliding pass over them.
Other requests are reduced to distinct keys and jobs before any join, and results come back by a left join on the same columns.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import countdict, temporal, vector
from ..operators import joins, validity
from ..operators.aggregates import INVERTIBLE, Aggregate, distinct_values
from .specs import AnyLeaf, AsAtAggregation, CalendarAggregation, ForwardAggregation, ItemAggregation, Lookup, WindowAggregation

PIT = "POINT_IN_TIME"
#: Seconds of the longest calendar unit of each kind.
_LONGEST = {"MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 7 * 86400, "MONTH": 31 * 86400, "QUARTER": 92 * 86400, "YEAR": 366 * 86400}


def _keyed(leaf: AnyLeaf) -> DataFrame:
    """The source with its key columns under the request's names and without rows of null keys."""
    df = leaf.source.df
    own = [F.col(f"`{c}`") for c in df.columns]
    out = df.select(*own, *[F.col(f"`{k}`").alias(f"__s_{s}") for k, s in zip(leaf.keys, leaf.serving, strict=True)])
    return out.dropna(subset=[f"__s_{s}" for s in leaf.serving]) if leaf.serving else out


def _value(leaf: AnyLeaf) -> Column:
    return F.col(f"`{leaf.value}`") if leaf.value else F.lit(1)


def _order(leaf: AnyLeaf) -> Column:
    return F.struct(temporal.micros(F.col(f"`{leaf.ts}`")).alias("t"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(leaf.tie)])


def _dictionaries(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of keys and __category to a dictionary for each column."""
    return df.groupBy(*keys).agg(*[countdict.from_rows(F.col("__category"), F.col(c)).alias(c) for c in columns])


def _aggregate(rows: DataFrame, keys: list[str], leaves: list[AnyLeaf], order: Column | None = None, category: str | None = None) -> DataFrame:
    """Direct aggregates of rows by keys (and category, into dictionaries)."""
    plain = [x for x in leaves if not x.vector]
    by = [*keys, *(["__category"] if category else [])]
    if category:
        rows = rows.withColumn("__category", F.col(f"`{category}`").cast("string"))
    out = None
    if plain:
        out = rows.groupBy(*by).agg(*[Aggregate(x.method).direct(_value(x), order).alias(x.column) for x in plain])
        out = _dictionaries(out, keys, [x.column for x in plain]) if category else out
    for x in leaves:
        if x.vector:
            one = vector.elementwise(rows, keys, x.value, x.method, x.column)
            out = one if out is None else out.join(one, keys, "full")
    return out


class Planner:
    """bounds: the first and last point in time of the request, as a filter on the sources' time columns reaches their scans."""

    def __init__(self, request: DataFrame, pit: str = PIT, prune: bool = True) -> None:
        self.request, self.pit = request, pit
        # microseconds since the epoch: a zoned time as a Python object would depend on the process's own time zone
        t = temporal.micros(F.col(f"`{pit}`"))
        self.bounds = request.agg(F.min(t), F.max(t)).first() if prune and pit in request.columns else None

    def attach(self, leaves: list[AnyLeaf]) -> DataFrame:
        out = self.request
        groups: dict[tuple, list[AnyLeaf]] = defaultdict(list)
        for x in dict.fromkeys(leaves):
            if isinstance(x, WindowAggregation):
                key = ("latest" if x.window is None else "distinct" if x.method == "count_distinct" else "window", x.source.token, x.keys, x.serving, x.category, x.schedule, x.ts, x.tie, x.vector, x.value if x.method == "count_distinct" or x.window is None else None)
            elif isinstance(x, CalendarAggregation):
                key = ("calendar", x.source.token, x.keys, x.serving, x.category, x.schedule, x.ts, x.tie, x.zone, x.window.unit, x.value if x.method == "count_distinct" else None)
            elif isinstance(x, ItemAggregation):
                key = ("item", x.source.token, x.keys, x.serving, x.category)
            elif isinstance(x, AsAtAggregation):
                key = ("asat", x.source.token, x.keys, x.serving, x.category, x.shift, x.start, x.end, x.method in INVERTIBLE and not x.vector)
            elif isinstance(x, ForwardAggregation):
                key = ("forward", x.source.token, x.keys, x.serving, x.category, x.window, x.offset, x.ts, x.tie)
            else:
                key = ("lookup", x.source.token, x.keys, x.serving, x.kind, x.shift, x.ts, x.end, x.unit, x.lag_units, x.tie)
            groups[key].append(x)
        for key, some in groups.items():
            out = getattr(self, f"_{key[0]}")(out, some)
        return out

    def _bounded(self, df: DataFrame, ts: str, back: int | None, ahead: int = 0) -> DataFrame:
        """Rows from back seconds before the first request to ahead seconds after the last one (back None: since ever).

        A plain comparison with constants, which scans and partitions take up.
        """
        if self.bounds is None or self.bounds[0] is None:
            return df
        low, high = self.bounds
        kind = dict(df.dtypes)[ts]
        if not kind.startswith("timestamp"):
            return df
        at = lambda t: F.timestamp_micros(F.lit(t)).cast(kind)
        c = F.col(f"`{ts}`")
        df = df.filter(c <= at(high + ahead * 1_000_000))
        return df if back is None else df.filter(c >= at(low - back * 1_000_000))

    def _merged(self, out: DataFrame, leaves: list[AnyLeaf], tiles: DataFrame, serving: tuple[str, ...], last: Column, spans: dict[tuple[int, int], list[AnyLeaf]]) -> DataFrame:
        """Joins each span's tiles [last - offset - n, last - offset) to distinct requests, merges and attaches them."""
        x0 = leaves[0]
        if not x0.category and not x0.vector and x0.method != "count_distinct":
            return self._sliding(out, tiles, serving, last, spans)
        mark = f"__last_{x0.column[6:]}"
        out = out.withColumn(mark, last)
        keys = [*serving, mark]
        asked = out.select(*keys).distinct().dropna()
        for (n, shift), some in spans.items():
            end = F.col(mark) - shift
            hits = joins.range_join(asked, tiles.withColumnRenamed("__idx", "__tile"), list(serving), end - n, end, F.col("__tile"), n)
            by = [*keys, *(["__category"] if x0.category else [])]
            if x0.method == "count_distinct":
                got = hits.groupBy(*by).agg(*[distinct_values(F.col("__value")).alias(x.column) for x in some])
            elif x0.vector:
                got = None
                for x in some:
                    if x.method == "avg":
                        # sums of vectors and counts of rows are merged one by one
                        flat = hits.filter(F.col(f"{x.column}_v").isNotNull())
                        one = vector.elementwise(flat, by, f"{x.column}_v", "sum", "__sum").join(flat.groupBy(*by).agg(F.sum(f"{x.column}_n").alias("__n")), by)
                        one = one.select(*by, F.transform("__sum", lambda e: e / F.col("__n")).alias(x.column))
                    else:
                        one = vector.elementwise(hits, by, f"{x.column}_v", x.method, x.column)
                    got = one if got is None else got.join(one, by, "full")
            else:
                part = lambda x: {s: F.col(f"{x.column}_{s}") for s in Aggregate(x.method).tile(F.lit(1), F.struct(F.lit(1)))}
                got = hits.groupBy(*by).agg(*[Aggregate(x.method).merge(part(x)).alias(x.column) for x in some])
            if x0.category:
                got = _dictionaries(got, keys, [x.column for x in some])
            out = joins.attach(out, got, keys)
        return out.drop(mark)

    def _sliding(self, out: DataFrame, tiles: DataFrame, serving: tuple[str, ...], last: Column, spans: dict[tuple[int, int], list[AnyLeaf]]) -> DataFrame:
        """Requests and tiles on one time line, each span a sliding frame on it: one exchange, and no join back.

        A key's time line is cut into buckets as wide as the furthest span reaches; a tile goes to its own bucket and the next, so a request
        finds all its tiles in its own. Requests that can't match (null key or job) are dealt by their hash.
        """
        wide = max(n + shift for n, shift in spans)
        keys = [f"__k{i}" for i in range(len(serving))]
        bucket = F.floor(F.col("__at") / F.lit(wide)).cast("bigint")
        row = F.struct(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(out.columns)])
        spread = F.xxhash64(*[F.col(f"`{c}`") for c, kind in out.dtypes if "map<" not in kind])
        named = [F.col(f"`{s}`").alias(k) for s, k in zip(serving, keys, strict=True)]
        asked = out.select(*named, last.cast("bigint").alias("__at"), row.alias("__l"), spread.alias("__spread"))
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, "__at"]])
        asked = asked.withColumn("__bucket", F.when(known, bucket).otherwise(F.col("__spread"))).drop("__spread")
        parts = {x.column: {s: f"{x.column}_{s}" for s in Aggregate(x.method).tile(F.lit(1), F.struct(F.lit(1)))} for some in spans.values() for x in some}
        told = tiles.select(*named, F.col("__idx").cast("bigint").alias("__at"), *[name for part in parts.values() for name in part.values()])
        told = told.withColumn("__bucket", F.explode(F.array(bucket, bucket + 1)))
        line = Window.partitionBy(*keys, "__bucket").orderBy("__at")
        found = []
        for (n, shift), some in spans.items():
            frame = line.rangeBetween(-(n + shift), -(shift + 1))
            found += [Aggregate(x.method).merge({s: F.col(c) for s, c in parts[x.column].items()}, frame).alias(x.column) for x in some]
        got = asked.unionByName(told, allowMissingColumns=True).select("__l", *found).filter(F.col("__l").isNotNull())
        return got.select(*[F.col("__l")[f"l{i}"].alias(c) for i, c in enumerate(out.columns)], *[x.column for some in spans.values() for x in some])

    def _tiles(self, rows: DataFrame, leaves: list[AnyLeaf], by: list[str]) -> DataFrame:
        x0 = leaves[0]
        if x0.category:
            rows = rows.withColumn("__category", F.col(f"`{x0.category}`").cast("string"))
            by = [*by, "__category"]
        if x0.method == "count_distinct":
            return rows.select(*by, _value(x0).alias("__value")).distinct()
        if x0.vector:
            out = None
            for x in leaves:
                method = "sum" if x.method == "avg" else x.method
                one = vector.elementwise(rows, by, x.value, method, f"{x.column}_v")
                if x.method == "avg":
                    one = one.join(rows.groupBy(*by).agg(F.count(F.col(f"`{x.value}`")).alias(f"{x.column}_n")), by)
                out = one if out is None else out.join(one, by, "full")
            return out
        return rows.groupBy(*by).agg(*[c.alias(f"{x.column}_{s}") for x in leaves for s, c in Aggregate(x.method).tile(_value(x), _order(x)).items()])

    def _renamed(self, df: DataFrame, serving: tuple[str, ...]) -> DataFrame:
        for s in serving:
            df = df.withColumnRenamed(f"__s_{s}", s) if s not in df.columns else df.drop(s).withColumnRenamed(f"__s_{s}", s)
        return df

    def _window(self, out: DataFrame, leaves: list[WindowAggregation]) -> DataFrame:
        x0 = leaves[0]
        s = x0.schedule
        rows = _keyed(x0).filter(F.col(f"`{x0.ts}`").isNotNull())
        rows = self._bounded(rows, x0.ts, max(x.window + x.offset for x in leaves) + s.p + s.b + 1)
        tiles = self._tiles(rows.withColumn("__idx", s.tile_index(F.col(f"`{x0.ts}`"))), leaves, [*[f"__s_{k}" for k in x0.serving], "__idx"])
        spans: dict[tuple[int, int], list[AnyLeaf]] = defaultdict(list)
        for x in leaves:
            spans[x.window // s.p, x.offset // s.p].append(x)
        return self._merged(out, leaves, self._renamed(tiles, x0.serving), x0.serving, s.last_tile(F.col(self.pit)), spans)

    _distinct = _window

    def _latest(self, out: DataFrame, leaves: list[WindowAggregation]) -> DataFrame:
        """Since ever: the last row before the job's window ends, through one tile for each period."""
        x0 = leaves[0]
        s = x0.schedule
        rows = self._bounded(_keyed(x0).filter(F.col(f"`{x0.ts}`").isNotNull()), x0.ts, None).withColumn("__idx", s.tile_index(F.col(f"`{x0.ts}`")))
        tiles = rows.groupBy(*[f"__s_{k}" for k in x0.serving], "__idx").agg(F.max_by(_value(x0), _order(x0)).alias("__v"))
        tiles = tiles.withColumn("__from", temporal.from_micros(s.tile_end_micros(F.col("__idx"))))
        mark = f"__end_{x0.column[6:]}"
        for x in leaves:
            asked = out.withColumn(mark, temporal.from_micros(s.tile_end_micros(s.last_tile(F.col(self.pit)) - x.offset // s.p)))
            keys = [*x0.serving, mark]
            got = joins.asof_join(asked.select(*keys).distinct(), tiles, list(x0.serving), [f"__s_{k}" for k in x0.serving], F.col(mark), F.col("__from"), {"__v": x.column}, exact=False, tie=["__idx"])
            out = joins.attach(asked, got, keys).drop(mark)
        return out

    def _calendar(self, out: DataFrame, leaves: list[CalendarAggregation]) -> DataFrame:
        x0 = leaves[0]
        unit, s = x0.window.unit, x0.schedule
        ts = temporal.local(F.col(f"`{x0.ts}`"), x0.zone)
        # a day more on either side for time zones, two days for the blind spot's calendar unit; ticks look back at most so far
        back = max(x.window.size + x.offset + 1 for x in leaves) * _LONGEST[unit] + s.b + s.longest_gap() + 3 * 86400
        rows = self._bounded(_keyed(x0).filter(F.col(f"`{x0.ts}`").isNotNull()), x0.ts, back, 86400).withColumn("__idx", temporal.calendar_index(ts, unit))
        tiles = self._tiles(rows, leaves, [*[f"__s_{k}" for k in x0.serving], "__idx"])
        points = s.job_times(out.select(self.pit).distinct(), self.pit)
        end = temporal.calendar_index(temporal.local(temporal.add(F.col("__job"), -s.b * 1_000_000), s.timezone), unit)
        mark = f"__until_{x0.column[6:]}"
        out = joins.attach(out, points.select(self.pit, end.alias(mark)), [self.pit])
        spans: dict[tuple[int, int], list[AnyLeaf]] = defaultdict(list)
        for x in leaves:
            spans[x.window.size, x.offset].append(x)
        return self._merged(out, leaves, self._renamed(tiles, x0.serving), x0.serving, F.col(mark), spans).drop(mark)

    def _item(self, out: DataFrame, leaves: list[ItemAggregation]) -> DataFrame:
        x0 = leaves[0]
        got = _aggregate(_keyed(x0), [f"__s_{k}" for k in x0.serving], leaves, None, x0.category)
        return joins.attach(out, self._renamed(got, x0.serving), list(x0.serving))

    def _asat(self, out: DataFrame, leaves: list[AsAtAggregation]) -> DataFrame:
        x0 = leaves[0]
        mark = f"__at_{x0.column[6:]}"
        out = out.withColumn(mark, temporal.add(F.col(self.pit), x0.shift * 1_000_000))
        keys = [*x0.serving, mark]
        asked = out.select(*keys).distinct().dropna()
        if all(x.method in INVERTIBLE and not x.vector for x in leaves) and x0.serving:
            got = self._running(asked, leaves, mark)
        else:
            got = self._covered(asked, leaves, mark)
        return joins.attach(out, got, keys).drop(mark)

    def _covered(self, asked: DataFrame, leaves: list[AsAtAggregation], mark: str) -> DataFrame:
        """Other aggregates of valid rows, by blocks of asked times that a row covers: linear but for a logarithm, where rows valid at each point would be listed."""
        x0 = leaves[0]
        serving, held = list(x0.serving), ["__level", "__block"]
        source = _keyed(x0)
        start, end = temporal.micros(F.col(f"`{x0.start}`")), temporal.micros(F.col(f"`{x0.end}`"))
        category = [F.coalesce(F.col(f"`{x0.category}`").cast("string"), F.lit(countdict.MISSING)).alias("__category")] if x0.category else []
        rows = source.select(*[F.col(f"`__s_{s}`").alias(s) for s in serving], start.alias("__a"), end.alias("__b"), *category, *[_value(x).alias(x.column) for x in leaves])
        rows = rows.filter("__a is not null and (__b is null or __b > __a)")
        asked = asked.select(*serving, temporal.micros(F.col(mark)).alias("__t"))
        asked, rows = validity.numbered(asked, rows, serving)
        asked = validity.holders(asked)
        keys = [*serving, "__t"]
        kinds = dict(rows.dtypes)
        by = ["__category"] if x0.category else []
        plain, tables, found = [x for x in leaves if not x.vector], [], []
        for some in ([x for x in plain if x.method != "count_distinct"], *[[x] for x in plain if x.method == "count_distinct"]):
            if some:
                each = rows if some[0].method != "count_distinct" else validity.disjoint(rows, [*serving, *by, some[0].column])
                parts = {f"{x.column}_{s}": c for x in some for s, c in Aggregate(x.method).parts(F.col(x.column), kinds[x.column].startswith("decimal")).items()}
                tables.append(validity.blocks(each).groupBy(*serving, *held, *by).agg(*[c.alias(name) for name, c in parts.items()]))
        if tables:
            table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
            direct = dict(rows.groupBy().agg(*[Aggregate(x.method).direct(F.col(x.column)).alias(x.column) for x in plain]).dtypes)
            part = lambda x: {s: F.col(f"{x.column}_{s}") for s in Aggregate(x.method).parts(F.lit(1))}
            whole = [Aggregate(x.method).whole(part(x)).cast(direct[x.column]).alias(x.column) for x in plain]
            got = asked.join(validity.told(table), [*serving, *held]).groupBy(*keys, *by).agg(*whole)
            found.append(_dictionaries(got, keys, [x.column for x in plain]) if x0.category else got)
        for x in leaves:
            if x.vector:
                flat = validity.blocks(rows.select(*serving, "__low", "__high", F.col(x.column).alias("__v")))

                def merged(flat: DataFrame, method: str, name: str) -> DataFrame:
                    table = vector.elementwise(flat, [*serving, *held], "__v", method, "__v")
                    return vector.elementwise(asked.join(validity.told(table), [*serving, *held]), keys, "__v", method, name)

                if x.method == "avg":
                    some = flat.withColumn("__v", F.transform("__v", lambda e: e.isNotNull().cast("int")))
                    one = merged(flat, "sum", "__sum").join(merged(some, "sum", "__some"), keys)
                    found.append(one.select(*keys, F.zip_with("__sum", "__some", F.try_divide).alias(x.column)))
                else:
                    found.append(merged(flat, x.method, x.column))
        got = reduce(lambda a, b: a.join(b, keys, "full"), found)
        return got.withColumnRenamed("__t", mark).withColumn(mark, temporal.from_micros(F.col(mark)))

    def _running(self, asked: DataFrame, leaves: list[AsAtAggregation], mark: str) -> DataFrame:
        """Counts and sums of valid rows as running sums of what begins and ends: linear, where rows valid at each point would be listed.

        asked is carried through an as-of join on the steps; with a category each category has steps of its own.
        """
        x0 = leaves[0]
        serving, keys = list(x0.serving), [*x0.serving, mark]
        rows = self._renamed(_keyed(x0), x0.serving)
        start, end = temporal.micros(F.col(f"`{x0.start}`")), temporal.micros(F.col(f"`{x0.end}`"))
        rows = rows.withColumn("__a", start).withColumn("__b", end).filter("__a is not null and (__b is null or __b > __a)")
        if x0.category:
            rows = rows.withColumn("__category", F.coalesce(F.col(f"`{x0.category}`").cast("string"), F.lit(countdict.MISSING)))
        by = [*serving, *(["__category"] if x0.category else [])]
        sums: dict[str, Column] = {"__rows": F.lit(1)}
        for x in leaves:
            v = _value(x)
            if x.method in ("sum", "avg"):
                exact = dict(rows.dtypes)[x.value] in ("tinyint", "smallint", "int", "bigint")
                sums[f"{x.column}_s"] = F.coalesce(v.cast("bigint" if exact else "decimal(38,10)"), F.lit(0))
                sums[f"{x.column}_n"] = v.isNotNull().cast("bigint")
            elif x.method == "na_count":
                sums[f"{x.column}_n"] = v.isNull().cast("bigint")
        one = lambda t, sign: rows.filter(F.col(t).isNotNull()).select(*by, F.col(t).alias("__t"), *[(c * sign).alias(n) for n, c in sums.items()])
        steps = one("__a", 1).unionByName(one("__b", -1)).groupBy(*by, "__t").agg(*[F.sum(n).alias(n) for n in sums])
        line = Window.partitionBy(*by).orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
        steps = steps.select(*by, temporal.from_micros(F.col("__t")).alias("__from"), *[F.sum(n).over(line).alias(n) for n in sums])
        if x0.category:
            kinds = steps.select(*by).distinct()
            asked = asked.join(kinds, serving)
        got = joins.asof_join(asked, steps, by, by, F.col(mark), F.col("__from"), {n: n for n in sums}, exact=True, tie=["__rows"]).filter("__rows > 0")
        final = []
        for x in leaves:
            n, s = F.col(f"{x.column}_n"), F.col(f"{x.column}_s")
            kind = "bigint" if x.value and dict(rows.dtypes)[x.value] in ("tinyint", "smallint", "int", "bigint") else "double"
            final.append({"count": lambda: F.col("__rows"), "na_count": lambda: n, "sum": lambda: F.when(n > 0, s).cast(kind), "avg": lambda: F.try_divide(s.cast("double"), n)}[x.method]().alias(x.column))
        got = got.select(*keys, *(["__category"] if x0.category else []), *final)
        return _dictionaries(got, keys, [x.column for x in leaves]) if x0.category else got

    def _forward(self, out: DataFrame, leaves: list[ForwardAggregation]) -> DataFrame:
        x0 = leaves[0]
        keys = [*x0.serving, self.pit]
        asked = out.select(*keys).distinct().dropna()
        rows = self._bounded(_keyed(x0).filter(F.col(f"`{x0.ts}`").isNotNull()), x0.ts, -x0.offset, x0.offset + x0.window + 1)
        rows = self._renamed(rows, x0.serving).withColumn("__when", temporal.epoch(F.col(f"`{x0.ts}`")))
        rows = rows.select(*[c for c in rows.columns if c != self.pit])
        low = temporal.epoch(F.col(self.pit)) + (x0.offset + 1)
        hits = joins.range_join(asked, rows, list(x0.serving), low, low + x0.window, F.col("__when"), x0.window)
        got = _aggregate(hits, keys, leaves, _order(x0), x0.category)
        return joins.attach(out, got, keys)

    def _lookup(self, out: DataFrame, leaves: list[Lookup]) -> DataFrame:
        x0 = leaves[0]
        serving = list(x0.serving)
        named = {x.value: x.column for x in leaves}
        if x0.kind == "history":
            mark = f"__at_{x0.column[6:]}"
            out = out.withColumn(mark, temporal.add(F.col(self.pit), x0.shift * 1_000_000))
            asked = out.select(*serving, mark).distinct()
            end = F.col(f"`{x0.end}`") if x0.end else None
            got = joins.asof_join(asked, x0.source.df, serving, list(x0.keys), F.col(mark), F.col(f"`{x0.ts}`"), named, end_ts=end, tie=list(x0.tie) or None)
            return joins.attach(out, got, [*serving, mark]).drop(mark)
        if x0.kind == "snapshot":
            mark = f"__at_{x0.column[6:]}"
            index = temporal.calendar_index(temporal.add(F.col(self.pit), x0.shift * 1_000_000), x0.unit) - x0.lag_units
            rows = x0.source.df.withColumn("__snap", temporal.calendar_index(F.col(f"`{x0.ts}`"), x0.unit))
            out = joins.equi_join(out.withColumn(mark, index), rows, [*serving, mark], [*x0.keys, "__snap"], named)
            return out.drop(mark)
        if x0.kind == "event":
            out = joins.equi_join(out, x0.source.df, serving, list(x0.keys), {**named, x0.ts: "__happened"})
            seen = temporal.micros(F.col("__happened")) <= temporal.micros(F.col(self.pit)) + x0.shift * 1_000_000
            return out.select(*[F.when(seen, F.col(c)).alias(c) if c in named.values() else F.col(f"`{c}`") for c in out.columns if c != "__happened"])
        return joins.equi_join(out, x0.source.df, serving, list(x0.keys), named)

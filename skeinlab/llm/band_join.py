"""Numeric band join of items and sale lines on near prices: adaptive recursive partitioning, range joins in DuckDB."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skeinlab.llm.common import Scratch, partitions

#: A band reaches `flat` cents, or `per_mille` thousandths of the item's price where that is more.
FLAT, PER_MILLE = 10, 2
#: Cents beyond this are not held exactly by doubles; such prices never pair.
MOST_CENTS = 2**53
#: Cells for each shuffle partition, and the load under which a cell is never split.
CELLS, LEAST_LOAD = 8, 2_000
#: Parts that the items of one price are dealt into when they take what was found for it.
SALTS = 8
#: Bins of the first histogram, and parts that a heavy bin is cut into in each further round.
BINS, FANOUT = 256, 16
#: A cut has to leave both sides under the first share of the region's load, or to add less than the second by what it replicates.
WORTH, ADDED = 0.8, 1.1

_BEST = "array<struct<gap:long,u:long,sale_id:long,line_no:long,line_item_id:long>>"


def cents(money: Column) -> Column:
    """floor(100 * x + 0.5) as a long; null where that is no number that doubles hold exactly."""
    c = F.floor(money.cast("double") * 100 + 0.5).try_cast("long")
    return F.when(F.isnan(money.cast("double")), None).when(F.abs(c) <= MOST_CENTS, c)


def priced_items(items: DataFrame) -> DataFrame:
    """(item_id, p, copies): items with a price in cents; equal rows are counted. Null ids and prices stay, they never pair."""
    return items.select(F.col("item_id").cast("long").alias("item_id"), cents(F.col("price")).alias("p")).groupBy("item_id", "p").agg(F.count(F.lit(1)).alias("copies"))


def priced_lines(sale_lines: DataFrame) -> DataFrame:
    """(u, sale_id, line_no, line_item_id, crc): lines with a unit price in cents, rounded half up in exact integers.

    Lines without sale, item, quantity or amount are left out, and those of no quantity, which have no unit price.
    """
    a, q = cents(F.col("amount")), F.col("quantity").cast("long")
    top, low = F.signum(q).cast("long") * (a * 2 + q), F.abs(q) * 2  # the divisor made positive
    found = sale_lines.select(
        F.when(q != 0, F.call_function("div", top - F.pmod(top, low), low)).alias("u"),
        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("item_id").cast("long").alias("line_item_id"),
    ).filter("u IS NOT NULL AND sale_id IS NOT NULL AND line_item_id IS NOT NULL")
    text = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("line_item_id").cast("string"))
    return found.withColumn("crc", F.crc32(text))


def width(p, flat: int = FLAT, per_mille: int = PER_MILLE):
    """Most cents between an item of p cents and a line that pairs with it."""
    return np.maximum(flat, per_mille * np.maximum(p, 0) // 1000)


@dataclass(frozen=True)
class Regions:
    """Regions of item prices in order, the line prices in their reach, and the grid of cells of each."""

    last: np.ndarray  # last item price of the region
    low: np.ndarray  # first and last line price in reach
    high: np.ndarray
    across: np.ndarray  # parts that its items, and its lines, are dealt into
    down: np.ndarray
    base: np.ndarray  # number of its first cell


def _histogram(points: DataFrame, edges: np.ndarray) -> np.ndarray:
    """Sums of lefts, rights and of the points that have some, for each bin [edges[k], edges[k + 1])."""

    def tally(batches):
        out = np.zeros((len(edges) - 1, 4), np.int64)
        for b in batches:
            price, lefts, rights = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = np.searchsorted(edges, price, "right") - 1
            for k, v in enumerate((lefts, rights, lefts > 0, rights > 0)):
                out[:, k] += np.bincount(at, weights=v, minlength=len(edges) - 1).astype(np.int64)
        at = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(out[at, k]) for k in range(4))], names=["bin", "a", "b", "c", "d"])

    sums = points.mapInArrow(tally, "bin long, a long, b long, c long, d long").groupBy("bin").agg(*[F.sum(c).alias(c) for c in "abcd"])
    out = np.zeros((len(edges) - 1, 4), np.int64)
    for r in sums.collect():  # one row for each bin; their number is bounded by the number of cells
        out[r.bin] = r.a, r.b, r.c, r.d
    return out


def _bins(points: DataFrame, cells: int, least: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Edges and sums of bins that are narrow where rows are many: heavy bins are cut again until they are light or one price wide."""
    ends = points.agg(F.min("price"), F.max("price"), F.sum("lefts"), F.sum("rights")).first()
    if not ends[2] or not ends[3]:
        return None
    light = max(least, (ends[2] + ends[3]) / cells) / 4
    step = max(1, -(-(ends[1] + 1 - ends[0]) // BINS))
    edges = np.append(np.arange(ends[0], ends[1] + 1, step, dtype=np.int64), ends[1] + 1)
    while True:
        sums = _histogram(points, edges)
        wide = np.diff(edges)
        heavy = np.flatnonzero((sums[:, 0] + sums[:, 1] > light) & (wide > 1))
        if not len(heavy):
            return edges, sums
        edges = np.unique(np.concatenate([edges, *(np.arange(edges[k], edges[k + 1], max(1, wide[k] // FANOUT)) for k in heavy)]))


def plan_regions(points: DataFrame, cells: int, flat: int = FLAT, per_mille: int = PER_MILLE, weigh: str = "points", least: int = LEAST_LOAD) -> Regions | None:
    """Split the heaviest region of item prices again and again until every cell is within the target load.

    The load of a region is its items, the lines in its reach (replicated over its borders) and the matches
    its join makes: pairs of distinct prices (weigh="points") or of rows ("rows"). A region whose load no cut
    lessens - one hot price, or hot lines within reach of both sides - is dealt out as a grid: items by
    columns, lines by rows. `points` has (price, lefts, rights), one row for each price. Only bins come to the
    driver, in number bounded by that of cells, which follows the cluster's shuffle partitions and not the rows.
    """
    found = _bins(points, cells, least)
    if found is None:
        return None
    edges, sums = found
    first, last = edges[:-1], edges[1:] - 1
    lefts, rights = np.append(0, np.cumsum(sums[:, 0])), np.append(0, np.cumsum(sums[:, 1]))
    from_bin = np.searchsorted(edges, first - width(first, flat, per_mille), "right") - 1
    to_bin = np.searchsorted(edges, last + width(last, flat, per_mille), "right")
    from_bin, to_bin = np.clip(from_bin, 0, len(first)), np.clip(to_bin, 0, len(first))
    a, b = (sums[:, 2], np.append(0, np.cumsum(sums[:, 3]))) if weigh == "points" else (sums[:, 0], rights)
    matches = np.append(0, np.cumsum(a.astype(float) * (b[to_bin] - b[from_bin])))

    def load(i, j):
        """Of the region of bins i to j - 1; either end may be an array."""
        return (lefts[j] - lefts[i]) + (rights[to_bin[j - 1]] - rights[from_bin[i]]) + (matches[j] - matches[i])

    n = len(first)
    target = max(least, load(0, n) / cells)
    heap, done = [(-float(load(0, n)), 0, n)], []
    while heap:
        size, i, j = heapq.heappop(heap)
        if -size > target:
            cuts = np.arange(i + 1, j)
            one, two = (load(i, cuts), load(cuts, j)) if len(cuts) else (np.array([np.inf]),) * 2
            worst = np.where((np.maximum(one, two) <= -size * WORTH) | (one + two <= -size * ADDED), np.maximum(one, two), np.inf)
            if worst.min() < np.inf:
                c = int(cuts[worst.argmin()])
                heapq.heappush(heap, (-float(load(i, c)), i, c))
                heapq.heappush(heap, (-float(load(c, j)), c, j))
                continue
        done.append((i, j))
    done.sort()
    i, j = np.array(done).T
    n_left, n_right, made = lefts[j] - lefts[i], rights[to_bin[j - 1]] - rights[from_bin[i]], matches[j] - matches[i]
    across, down = np.maximum(1, np.ceil(2 * n_left / target)), np.maximum(1, np.ceil(2 * n_right / target))
    small = n_left + n_right + made <= target
    across, down = np.where(small, 1, across).astype(np.int64), np.where(small, 1, down).astype(np.int64)
    if weigh == "rows":  # the matches of a cell are bounded as well
        down = np.where(small, 1, np.maximum(down, np.ceil(made / across / target))).astype(np.int64)
    p0, p1 = first[i], last[j - 1]
    return Regions(p1, p0 - width(p0, flat, per_mille), p1 + width(p1, flat, per_mille), across, down, np.append(0, np.cumsum(across * down))[:-1])


def _repeat(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, each as often as counted, and 0, 1, ... within each."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def _deal_prices(left: DataFrame, to: Regions) -> DataFrame:
    """Rows with a price p, their first column, with the number of each cell they go to: their region's, in all rows of one column of its grid."""
    schema = T.StructType([T.StructField("cell", T.LongType()), *left.schema.fields])

    def deal(batches):
        seen = 0
        for b in batches:
            r = np.searchsorted(to.last, b.column(0).to_numpy(zero_copy_only=False), "left")
            column = (np.arange(len(r)) + seen) % to.across[r]
            rows, k = _repeat(to.down[r])
            yield pa.RecordBatch.from_arrays([pa.array(to.base[r[rows]] + column[rows] * to.down[r[rows]] + k), *b.take(pa.array(rows)).columns], names=["cell", *b.schema.names])
            seen += len(r)

    return left.mapInArrow(deal, schema)


def _deal_lines(right: DataFrame, to: Regions) -> DataFrame:
    """Lines with the number of each cell they go to: of every region in whose reach they lie, in all columns of one row of its grid.

    The row is the place of the line among those of its task, so that equal lines are dealt out as well.
    """

    def deal(batches):
        seen = 0
        for b in batches:
            u = b.column(0).to_numpy(zero_copy_only=False)
            start, end = np.searchsorted(to.high, u, "left"), np.searchsorted(to.low, u, "right")
            rows, k = _repeat(np.maximum(0, end - start))
            r = start[rows] + k
            line = (rows + seen) % to.down[r]
            again, k = _repeat(to.across[r])
            cell = to.base[r[again]] + k * to.down[r[again]] + line[again]
            yield pa.RecordBatch.from_arrays([pa.array(cell), *b.take(pa.array(rows[again])).columns], names=["cell", *b.schema.names])
            seen += len(u)

    return right.mapInArrow(deal, "cell long, u long, sale_id long, line_no long, line_item_id long, crc long")


def _connection():
    """One DuckDB of one thread for each Python worker."""
    import duckdb

    if not hasattr(_connection, "held"):
        _connection.held = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
    return _connection.held


# Lines are summed up by price and the range join pairs prices. The first `k` lines that are not of one item are among
# the first 2 k if no item has over k of them; prices further off are left out once nearer ones have k lines
# whichever item is left out.
_NEAREST = """
WITH held AS MATERIALIZED (
    SELECT u, sale_id, line_no, line_item_id FROM lines
    QUALIFY row_number() OVER (PARTITION BY u, line_item_id ORDER BY sale_id, line_no NULLS FIRST) <= {k}),
best AS MATERIALIZED (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY u ORDER BY sale_id, line_no NULLS FIRST, line_item_id) <= 2 * {k}),
room AS (SELECT u, sum(c) - max(c) AS others FROM (SELECT u, line_item_id, count(*) AS c FROM best GROUP BY ALL) GROUP BY u),
points AS MATERIALIZED (SELECT u, n, crc, others FROM (SELECT u, count(*) AS n, sum(crc) AS crc FROM lines GROUP BY u) JOIN room USING (u)),
near AS MATERIALIZED (SELECT p, u, n, crc, others, abs(u - p) AS gap FROM banded JOIN points ON u >= lo AND u <= hi),
sums AS (SELECT p, sum(n) AS n, sum(n * gap) AS gap, sum(crc) AS crc FROM near GROUP BY p),
wanted AS (SELECT p, u, gap, coalesce(sum(others) OVER (PARTITION BY p ORDER BY gap, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearer FROM near),
few AS (SELECT p, gap, u, sale_id, line_no, line_item_id FROM wanted JOIN best USING (u) WHERE nearer < {k}
        QUALIFY row_number() OVER (PARTITION BY p, line_item_id ORDER BY gap, u, sale_id, line_no NULLS FIRST) <= {k}),
first AS (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY p ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) <= 2 * {k}),
listed AS (SELECT p, list({{'gap': gap, 'u': u, 'sale_id': sale_id, 'line_no': line_no, 'line_item_id': line_item_id}}) AS best FROM first GROUP BY p)
SELECT p, CAST(s.n AS BIGINT) AS n, CAST(s.gap AS BIGINT) AS gap, CAST(s.crc AS BIGINT) AS crc, best FROM sums s JOIN listed USING (p)
"""

_PAIRS = "SELECT item_id, p, abs(u - p) AS gap, u, sale_id, line_no, line_item_id FROM banded JOIN lines ON u >= lo AND u <= hi AND line_item_id <> item_id"


def _join_cells(left: DataFrame, right: DataFrame, sql: str, schema: str, weigh: str, flat: int, per_mille: int, cells: int | None, least: int) -> DataFrame | None:
    """The SQL over each cell's rows with a price p (banded, with lo and hi) and lines; None if one side is empty."""
    scratch = Scratch(left.sparkSession)
    points = left.select(F.col("p").alias("price"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col("u").alias("price"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    points = scratch.cut(points.groupBy("price").agg(F.sum("l").alias("lefts"), F.sum("r").alias("rights")), "price-points")
    to = plan_regions(points, cells or CELLS * partitions(left.sparkSession), flat, per_mille, weigh, least)
    if to is None:
        return None

    def join(prices: pa.Table, lines: pa.Table) -> pa.Table:
        p = prices.column("p").to_numpy()
        banded = prices.append_column("lo", pa.array(p - width(p, flat, per_mille))).append_column("hi", pa.array(p + width(p, flat, per_mille)))
        con = _connection()
        con.register("banded", banded)
        con.register("lines", lines)
        out = con.sql(sql).to_arrow_table()
        con.unregister("banded")
        con.unregister("lines")
        return out

    return _deal_prices(left, to).groupBy("cell").cogroup(_deal_lines(right, to).groupBy("cell")).applyInArrow(join, schema)


def band_pairs(items: DataFrame, sale_lines: DataFrame, flat: int = FLAT, per_mille: int = PER_MILLE, cells: int | None = None, least: int = LEAST_LOAD) -> DataFrame:
    """(item_id, p, gap, u, sale_id, line_no, line_item_id): every pair of an item row and a line of another item within the band.

    Cells are bounded by the pairs they make. Repeated items and lines each count. The pairs grow with the
    product of both tables; nearest_lines sums them up without listing them. Nulls: see nearest_lines.
    """
    left = priced_items(items).filter("item_id IS NOT NULL AND p IS NOT NULL")
    schema = "item_id long, p long, gap long, u long, sale_id long, line_no long, line_item_id long"
    found = _join_cells(left.select("p", "item_id"), priced_lines(sale_lines), _PAIRS, schema, "rows", flat, per_mille, cells, least)
    if found is None:
        return items.sparkSession.createDataFrame([], schema)
    many = left.filter("copies > 1").select("item_id", "p", F.explode(F.sequence(F.lit(2), F.col("copies"))).alias("_again"))
    return found.unionByName(found.join(many.drop("_again"), ["item_id", "p"]))


def _own_lines(left: DataFrame, right: DataFrame, flat: int, per_mille: int) -> DataFrame:
    """(item_id, p, own_n, own_gap, own_crc): sums over the lines of an item itself within its band, which are no pairs.

    Lines are summed up by item and price before they move, so a hot item has a row for each of its prices.
    """
    mine = right.groupBy(F.col("line_item_id").alias("item_id"), "u").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("crc"))
    gap = F.abs(F.col("u") - F.col("p"))
    reach = F.greatest(F.lit(flat), F.call_function("div", F.greatest("p", F.lit(0)) * per_mille, F.lit(1000)))
    near = left.select("item_id", "p").join(mine, "item_id").filter(gap <= reach)
    return near.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * gap).alias("own_gap"), F.sum("crc").alias("own_crc"))


def nearest_lines(items: DataFrame, sale_lines: DataFrame, k: int = 5, flat: int = FLAT, per_mille: int = PER_MILLE, cells: int | None = None, least: int = LEAST_LOAD) -> DataFrame:
    """The first k lines of other items within the band of each item's price, and sums over all of its pairs.

    The distinct prices of items are cut into regions and grids of cells (plan_regions); prices and lines are dealt
    to the cells, lines within reach of several regions to each of them, and DuckDB joins each cell. A price's
    partial sums and lists - long enough whichever one item is left out - meet by price, items take their price's by
    an equi-join, salted as many items may have one price, and an item's own lines are taken off again.
    Returns item_id, rank (from 1), gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc; an item
    without pairs has one row of rank 0.

    Lines null in sale_id, item_id, quantity or amount, or of quantity 0, never pair, nor do items null in
    item_id or price (they have their row of rank 0); amounts and prices that are no numbers, or beyond 2^53
    cents, count as null. A null line_no sorts first and is the empty text in a checksum. Repeated lines each
    count and take a rank each; repeated item rows each get their rows. An empty items table gives no rows.
    Extra columns are ignored.
    """
    every, right = priced_items(items), priced_lines(sale_lines)
    left = every.filter("item_id IS NOT NULL AND p IS NOT NULL")
    found = _join_cells(left.select("p").distinct(), right, _NEAREST.format(k=k), f"p long, n long, gap long, crc long, best {_BEST}", "points", flat, per_mille, cells, least)
    sums = ("n_pairs", "gap_sum", "lines_crc")
    if found is None:
        each = every.withColumns({c: F.lit(0).cast("long") for c in sums}).withColumn("best", F.array().cast(_BEST))
    else:
        whole = found.groupBy("p").agg(F.sum("n").alias("n"), F.sum("gap").alias("gap"), F.sum("crc").alias("crc"), F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))  # at most 2 k from each cell
        whole = whole.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = _own_lines(left, right, flat, per_mille)
        each = every.withColumn("_salt", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int")).join(whole, ["p", "_salt"], "left")
        each = each.join(own, ["item_id", "p"], "left").withColumns({a: F.when(F.col("item_id").isNull(), 0).otherwise(F.coalesce(b, F.lit(0)) - F.coalesce(f"own_{b}", F.lit(0))) for a, b in zip(sums, ("n", "gap", "crc"))})
        other = F.slice(F.filter("best", lambda x: x["line_item_id"] != F.col("item_id")), 1, k)
        each = each.withColumn("best", F.when(F.col("n_pairs") > 0, other))
    each = each.select("item_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"), *sums, "best")
    each = each.select("item_id", F.posexplode_outer("best").alias("_place", "_line"), *sums)
    return each.select("item_id", F.coalesce(F.col("_place") + 1, F.lit(0)).alias("rank"), *[F.col(f"_line.{c}").alias(c) for c in ("gap", "u", "sale_id", "line_no", "line_item_id")], *sums)


# CRC-32 by the table that follows from the reflected polynomial; pairs by one range join.
ORACLE_SQL = """
WITH tab AS (SELECT list(list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])),
                lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY n) AS tb FROM range(256) r(n)),
i AS (SELECT row_number() OVER () AS row_id, item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM items),
a AS (SELECT sale_id, CAST(line_no AS BIGINT) AS line_no, item_id AS line_item_id, quantity, CAST(floor(100 * amount + 0.5) AS BIGINT) AS a FROM sale_lines
      WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL AND quantity <> 0),
l AS MATERIALIZED (SELECT sale_id, line_no, line_item_id, (2 * a + quantity) // (2 * quantity) AS u,
      hex(encode(sale_id || ',' || coalesce(CAST(line_no AS VARCHAR), '') || ',' || line_item_id)) AS x FROM a),
c AS MATERIALIZED (SELECT sale_id, line_no, line_item_id, u, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                list_transform(range(length(x) // 2), lambda i: CAST(('0x' || x[2*i+1:2*i+2]) AS BIGINT))),
                lambda a, b: xor(a >> 8, tb[1 + (xor(a, b) & 255)]))) AS crc FROM l, tab),
j AS (SELECT row_id, i.item_id, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc FROM i JOIN c
      ON u BETWEEN p - greatest(10, 2 * p // 1000) AND p + greatest(10, 2 * p // 1000) AND line_item_id <> i.item_id),
s AS (SELECT row_id, count(*) AS n_pairs, CAST(sum(gap) AS BIGINT) AS gap_sum, CAST(sum(crc) AS BIGINT) AS lines_crc FROM j GROUP BY 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS INTEGER) AS rank FROM j)
SELECT i.item_id, coalesce(rank, 0) AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
FROM i LEFT JOIN s USING (row_id) LEFT JOIN (SELECT * FROM r WHERE rank <= 5) r ON r.row_id = i.row_id
"""

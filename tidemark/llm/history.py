"""Checking new batches against everything accepted before.

A segment index for bounded distances. A stem is cut into ``edits + 1`` segments of
nearly equal length, stored under its length, their position and their content: a stem
within ``edits`` changes leaves one of them whole. A batch probes, for every length within
reach, the substrings that can be such a segment, at its own and at shifted positions, and each
candidate is verified by its bounded edit distance. With no edits allowed the one segment is the whole stem.
The 64 bits of a hash are a string of one length that only substitutions change, so nothing shifts: five segments,
of which three differing bits leave two whole, stored in pairs under their places.

Stored segments lie in cells by a hash of their key, as many as the rows appended need, up to ``MOST_CELLS``.
A batch reads the cells that its probes name and no others; a batch of one row names at most
ten. Batches are taken one after the other, and what is accepted of each is appended, as one more generation of cells,
before the next is checked against it. Generations that are there when a call begins do not change during it, so all batches
of the call probe those at once. ``compact`` joins generations.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.images import records
from tidemark.operators.hamming import choices_of, hot_buckets, match_segments, segments
from tidemark.session import Scratch

THRESHOLD = 3
EDITS = 0
# Rows to a cell, and cells to a generation at most; both powers of two.
CELL_ROWS, MOST_CELLS = 1 << 16, 1 << 12
# Probing rows, of some tens of bytes, that may be broadcast.
MOST_SENT = 1_000_000


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and a maker of its paths."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class CellStore:
    """Rows below ``path`` in cells by a hash of their key columns, in one generation for each append."""

    def __init__(self, spark: SparkSession, path: str, shape: str, key: list[str], cell_rows: int = CELL_ROWS) -> None:
        self.spark, self.path, self.shape, self.key, self.cell_rows = spark, path, shape, key, cell_rows
        # Cells of each generation, and those of them that hold rows.
        self.generations: dict[int, tuple[int, set[int]]] = {}

    def cell(self) -> Column:
        """The cell of a row with the key columns, before it is cut to the cells of a generation."""
        return F.xxhash64(*self.key).bitwiseAND(F.lit(MOST_CELLS - 1)).cast("int")

    def last(self) -> int:
        """The number of the newest generation, -1 without any."""
        return max(self.generations, default=-1)

    def append(self, rows: DataFrame, count: int) -> None:
        """Add ``rows``, about ``count`` of them, as a new generation."""
        cells = min(MOST_CELLS, 1 << (max(0, count - 1) // self.cell_rows).bit_length())
        number = self.last() + 1
        placed = rows.withColumn("cell", self.cell().bitwiseAND(F.lit(cells - 1))).repartition(cells, "cell").sortWithinPartitions("cell", *self.key)
        placed.write.partitionBy("cell").parquet(f"{self.path}/gen={number}")
        files, at = _files(self.spark, self.path)
        names = [f.getPath().getName() for f in files.listStatus(at(f"{self.path}/gen={number}"))]
        self.generations[number] = cells, {int(n[5:]) for n in names if n.startswith("cell=")}

    def rows(self) -> DataFrame:
        """Every stored row."""
        return self.named(range(MOST_CELLS))

    def named(self, wanted: Iterable[int], after: int = -1) -> DataFrame:
        """The rows in the cells ``wanted`` (values of ``cell``) of the generations ``after`` one; the folders of no other cell are opened or listed."""
        asked = set(wanted)
        paths = [f"{self.path}/gen={g}/cell={c}" for g, (cells, held) in self.generations.items() if g > after for c in sorted(held & {w & (cells - 1) for w in asked})]
        if not paths:
            return self.spark.createDataFrame([], self.shape)
        return self.spark.read.schema(self.shape).parquet(*paths)

    def compact(self) -> None:
        """Join all generations into one; readers of the old ones must be done."""
        if len(self.generations) > 1:
            old, rows = list(self.generations), self.rows()
            self.append(rows, rows.count())
            files, at = _files(self.spark, self.path)
            for number in old:
                files.delete(at(f"{self.path}/gen={number}"), True)
                del self.generations[number]


def stem_segments(stems: DataFrame, edits: int) -> DataFrame:
    """``stem_key, length, place, part``: the stored segments of distinct stems."""
    parts = edits + 1
    cut = lambda k: F.floor(F.col("length") * k / F.lit(parts)).cast("int")
    held = F.array(*(F.struct(F.lit(k).alias("place"), F.substring(F.col("stem_key"), cut(k) + 1, cut(k + 1) - cut(k)).alias("part")) for k in range(parts)))
    return stems.withColumn("length", F.length("stem_key")).select("stem_key", "length", F.explode(held).alias("s")).select("stem_key", "length", "s.place", "s.part")


def stem_probes(stems: DataFrame, edits: int) -> DataFrame:
    """The other columns and ``stem_key, length, place, part``: the substrings of distinct stems that may be a segment of a stem within ``edits``.

    Position k of a stem of that length is tried at shifts of at most k to either side of its own place and at most
    ``edits - k`` of the place counted from the end: what lies before it, and what lies behind it, cannot use more edits.
    """
    parts, out = edits + 1, None
    others = [c for c in stems.columns if c != "stem_key"]
    for change in range(-edits, edits + 1):
        for k in range(parts):
            length = F.length("stem_key") + change
            start, end = F.floor(length * k / F.lit(parts)).cast("int"), F.floor(length * (k + 1) / F.lit(parts)).cast("int")
            low = F.greatest(F.lit(0), start - k, start - change - (edits - k))
            high = F.least(F.length("stem_key") - (end - start), start + k, start - change + (edits - k))
            shifts = F.when((length >= 0) & (low <= high), F.sequence(low, high))
            at = stems.select(*others, "stem_key", length.alias("length"), F.lit(k).alias("place"), (end - start).alias("size"), F.explode(shifts).alias("at"))
            at = at.select(*others, "stem_key", "length", "place", F.expr("substring(stem_key, at + 1, size)").alias("part"))
            out = at if out is None else out.unionAll(at)
    return out.distinct() if edits else out


def near_stems(probes: DataFrame, stored: DataFrame, edits: int) -> DataFrame:
    """``stem_key, other``: probing stems and the stored stems within ``edits`` of them."""
    key = ["length", "place", "part"]
    met = probes.join(stored.withColumnRenamed("stem_key", "other"), key).select("stem_key", "other").distinct()
    distance = F.levenshtein("stem_key", "other", edits) if edits else F.when(F.col("stem_key") == F.col("other"), 0).otherwise(-1)
    return met.where(distance >= 0)


class SegmentIndex:
    """Stored segments of all accepted records, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, threshold: int = THRESHOLD, edits: int = EDITS, cell_rows: int = CELL_ROWS) -> None:
        self.threshold, self.edits = threshold, edits
        self.hashes = CellStore(spark, f"{path}/hashes", "hash bigint, choice int, bucket bigint", ["choice", "bucket"], cell_rows)
        self.stems = CellStore(spark, f"{path}/stems", "stem_key string, length int, place int, part string", ["length", "place", "part"], cell_rows)

    def append(self, accepted: DataFrame, count: int) -> None:
        """Add the segments of about ``count`` records with ``stem_key, real_hash``, a written table."""
        hashes = _distinct(accepted, "real_hash").withColumnRenamed("real_hash", "hash")
        self.hashes.append(segments(hashes, self.threshold), count * len(choices_of(self.threshold)))
        self.stems.append(stem_segments(_distinct(accepted, "stem_key"), self.edits), count * (self.edits + 1))


def _distinct(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def _parted(scratch: Scratch, rows: DataFrame, tag: str) -> dict[bool, str]:
    """Write rows that have ``leads``: the folders of those that lead and of those that do not, where there are any."""
    scratch.save(rows, tag, ("leads",))
    path = scratch.tables[-1][1]
    files, at = _files(scratch.spark, path)
    return {leads: folder for leads in (True, False) if files.exists(at(folder := f"{path}/leads={str(leads).lower()}"))}


def _settle(scratch: Scratch, rows: DataFrame, near: dict[str, DataFrame]) -> list[str]:
    """Folders with ``id, stem_key, real_hash`` of the rows accepted in order of id, each unless an accepted earlier one shows the same image.

    Rows that ``leads`` marks share their image with no other row and are accepted. A round accepts every other row that comes before all undecided
    rows of its image; those of that image are turned away as the next round begins. The first undecided id is kept for each stem and hash, so copies are
    never paired; ``near`` has both directions of the pairs of different keys that show one image.
    """
    read = scratch.spark.read.schema(rows.drop("leads").schema).parquet

    def spread(held: DataFrame, column: str, value: list[str]) -> DataFrame:
        """``held`` (a key and values) at the key itself and at the keys near it."""
        if column not in near:
            return held
        beside = near[column].join(held.withColumnRenamed(column, "other"), "other").select(column, *value)
        return held.unionAll(beside)

    parts, accepted, taken = _parted(scratch, rows, "fresh"), [], None
    while True:
        accepted += [parts[True]] if True in parts else []
        if False not in parts:
            return accepted
        waiting = read(parts[False])
        if taken is not None:
            for column in ("stem_key", "real_hash"):
                waiting = waiting.join(spread(_distinct(taken, column), column, []), column, "left_anti")
        judged = waiting
        for column in ("stem_key", "real_hash"):
            own = waiting.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("id").alias("first"))
            judged = judged.join(spread(own, column, ["first"]).groupBy(column).agg(F.min("first").alias(f"first_{column}")), column, "left")
        leads = F.coalesce(F.col("first_stem_key") >= F.col("id"), F.lit(True)) & F.coalesce(F.col("first_real_hash") >= F.col("id"), F.lit(True))
        parts = _parted(scratch, judged.select("id", "stem_key", "real_hash", leads.alias("leads")), "judged")
        taken = read(parts[True]) if True in parts else None


def _cells(table: DataFrame, store: CellStore) -> dict[object, set[int]]:
    """The cells that the probes of each batch name."""
    named: dict[object, set[int]] = {}
    for r in table.select("batch", store.cell().alias("cell")).distinct().collect():
        named.setdefault(r.batch, set()).add(r.cell)
    return named


def screen(scratch: Scratch, batches: DataFrame, index: SegmentIndex) -> list[str]:
    """Folders with ``id, stem_key, real_hash`` of the accepted rows of all batches, taken one after the other and appended to the index.

    ``batches`` has the same columns and ``batch``. Batches are taken in order, a null one first, and rows of a batch by id. What is stored
    beforehand is probed for all batches that are there at once, as are the near pairs among them; what the call appends is probed
    by each batch in its turn. A row without stem and hash shows no known image and is accepted.
    """
    before = index.hashes.last(), index.stems.last()
    per_row = max(len(choices_of(index.threshold)), (2 * index.edits + 1) ** 3)
    # Probes whose counted rows are few are sent to the index, which then is not shuffled.
    sent = lambda table, rows: F.broadcast(table) if rows * per_row <= MOST_SENT else table
    # Rows alike in stem and hash share their fate but for the first, so only that one is judged.
    bare = F.when(F.col("stem_key").isNull() & F.col("real_hash").isNull(), F.col("id"))
    firsts = scratch.save(batches.groupBy("batch", "stem_key", "real_hash", bare.alias("bare")).agg(F.min("id").alias("id")).select("id", "stem_key", "real_hash", "batch"), "firsts")
    total = firsts.count()
    single = scratch.save(segments(_distinct(firsts, "real_hash").withColumnRenamed("real_hash", "hash"), index.threshold), "probes")
    stem_side = scratch.save(stem_probes(_distinct(firsts, "stem_key"), index.edits), "stem-probes")
    asked, asked_stems = (set().union(*_cells(t.withColumn("batch", F.lit(0)), store).values()) for t, store in ((single, index.hashes), (stem_side, index.stems)))
    known = index.hashes.named(asked)
    over: DataFrame | bool = scratch.save(hot_buckets(single, known.join(single.select("choice", "bucket"), ["choice", "bucket"], "left_semi")), "hot")
    over = False if over.isEmpty() else over
    pairs = match_segments(single, None, index.threshold, over=over)
    both = F.array(F.struct(F.col("hash_a").alias("real_hash"), F.col("hash_b").alias("other")), F.struct(F.col("hash_b").alias("real_hash"), F.col("hash_a").alias("other")))
    near = {"real_hash": scratch.save(pairs.select(F.explode(both).alias("p")).select("p.*"), "near")}
    if index.edits:
        met = near_stems(stem_side, stem_segments(_distinct(firsts, "stem_key"), index.edits), index.edits)
        near["stem_key"] = scratch.save(met.where(F.col("stem_key") != F.col("other")), "near-stems")

    def unseen(rows: DataFrame, probes: DataFrame, known: DataFrame, stem_side: DataFrame, known_stems: DataFrame, count: int) -> DataFrame:
        """The rows of which no stored one shows the image."""
        # A key may be near many stored ones: distinct, no more is sent than was probed. Equal stems meet one.
        seen = match_segments(sent(probes, count), known, index.threshold, over=over).select(F.col("hash_a").alias("real_hash")).distinct()
        seen_stems = near_stems(sent(stem_side, count), known_stems, index.edits).select("stem_key")
        seen_stems = seen_stems.distinct() if index.edits else seen_stems
        return rows.join(sent(seen, count), "real_hash", "left_anti").join(sent(seen_stems, count), "stem_key", "left_anti")

    left = scratch.save(unseen(firsts, single, known, stem_side, index.stems.named(asked_stems), total), "left")
    # A row leads from the start if its stem and hash are of no other row and near none.
    marked = left
    for column in ("stem_key", "real_hash"):
        crowded = left.where(F.col(column).isNotNull()).groupBy(column).count().where(F.col("count") > 1).select(column)
        if column in near:
            crowded = crowded.unionAll(near[column].select(column)).distinct()
        marked = marked.join(crowded.withColumn(f"crowded_{column}", F.lit(True)), column, "left")
    alone = F.col("crowded_stem_key").isNull() & F.col("crowded_real_hash").isNull()
    waiting = scratch.save(marked.select("id", "stem_key", "real_hash", alone.alias("leads"), "batch"), "waiting", ("batch",))
    hash_side = lambda rows, *keep: segments(rows.where(F.col("real_hash").isNotNull()).withColumnRenamed("real_hash", "hash"), index.threshold, keep=keep)
    stems_of = lambda rows, *keep: stem_probes(rows.where(F.col("stem_key").isNotNull()).select(*keep, "stem_key"), index.edits)
    cells, stem_cells = _cells(hash_side(waiting, "batch"), index.hashes), _cells(stems_of(waiting, "batch"), index.stems)

    sizes, accepted = {r.batch: r.n for r in waiting.groupBy("batch").agg(F.count("*").alias("n")).collect()}, []
    for batch in sorted(sizes, key=lambda b: (b is not None, b)):
        rows = waiting.where(F.col("batch").eqNullSafe(F.lit(batch))).drop("batch")
        known, known_stems = index.hashes.named(cells.get(batch, ()), before[0]), index.stems.named(stem_cells.get(batch, ()), before[1])
        fresh = unseen(rows, hash_side(rows), known, stems_of(rows), known_stems, sizes[batch])
        taken = _settle(scratch, fresh.select("id", "stem_key", "real_hash", "leads"), near)
        if taken:
            index.append(scratch.spark.read.schema(rows.drop("leads").schema).parquet(*taken), sizes[batch])
        accepted += taken
    return accepted


def _in_runs(sizes: dict[object, int], least: int) -> list[tuple[object, int, int]]:
    """``(batch, place, run)`` in order: following batches make one run until it has ``least`` rows."""
    placed, run, held = [], 0, 0
    for place, batch in enumerate(sorted(sizes, key=lambda b: (b is not None, b))):
        if held >= least:
            run, held = run + 1, 0
        placed.append((batch, place, run))
        held += sizes[batch]
    return placed


def screened(items: DataFrame, batches: DataFrame, threshold: int = THRESHOLD, edits: int = EDITS, cell_rows: int = CELL_ROWS, run_rows: int = 1) -> DataFrame:
    """``new_id, accepted`` of all batches: an index is built from the items once, and each batch in turn is screened and appended.

    Batches are taken by ``batch_no``, a null one first, and rows of a batch by ``new_id``. Every batch is screened against what was appended of those
    before it; only a caller who asks for ``run_rows`` has smaller ones screened together with the next, in the same order. Repeated ids are identical
    rows and count once, rows without an id not at all. Null stems and null or 0 hashes show no image. Without items the first
    batch is checked against itself alone.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "history")
    index = SegmentIndex(spark, f"{scratch.root}/index", threshold, edits, cell_rows)
    base = scratch.save(records(items, "item_id"), "items")
    index.append(base, base.count())
    new = scratch.save(records(batches, "new_id", F.col("batch_no").alias("batch_no")), "new")
    sizes = {r.batch_no: r.n for r in new.groupBy("batch_no").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(_in_runs(sizes, run_rows), f"named {dict(new.dtypes)['batch_no']}, place int, batch int")
    # One number in the order of batch and id.
    turn = F.col("place").cast("decimal(10,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + F.col("id").cast("decimal(20,0)")
    rows = scratch.save(new.join(F.broadcast(runs), F.col("batch_no").eqNullSafe(F.col("named"))).select(F.col("id").alias("new_id"), turn.cast("decimal(38,0)").alias("id"), "stem_key", "real_hash", "batch"), "turns")
    taken = screen(scratch, rows.drop("new_id"), index)
    whole = spark.read.schema(rows.select("id").schema).parquet(*taken) if taken else rows.select("id").limit(0)
    told = rows.join(whole.withColumn("accepted", F.lit(True)), "id", "left")
    return scratch.finish(told.select("new_id", F.coalesce("accepted", F.lit(False)).alias("accepted")))

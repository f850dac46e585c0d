"""What the operators share: words, folds, chunks, bounded training samples, checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage
# return. ``bytes.split()`` without arguments cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Documents no model may learn from: one fold of five by the id's crc32."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone (52 bits of an md5)."""
    text = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder all executors share, and go on from there.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, as in tests on
    one machine, a folder of our own is made; a cluster without the setting is refused.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset")
            folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def share(full: int, strata: int, found: int, least: int) -> int:
    """What each of ``found`` strata gets of a bound of ``full`` for each of ``strata``."""
    return min(full, max(least, full * strata // max(1, found)))


def bounded_sample(rows: DataFrame, stratum: str, per_stratum: int, strata: int, seed: str, least: int = 20) -> list:
    """At most about ``per_stratum`` rows of each value of ``stratum``, for fitting a model.

    ``rows`` has doc_id and the stratum. The counts cover all rows; each stratum is then
    thinned to its share by a draw on the id, so the sample repeats from run to run and no
    group meets in one task. Every value is sampled: where there are more than ``strata``, they
    share what so many would get, but each gets ``least``. So what reaches the driver is bounded
    by ``per_stratum * strata`` rows or ``least`` a value (within the draw's noise).
    """
    counts = rows.where(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()
    if not counts:
        return []
    each = share(per_stratum, strata, len(counts), least)
    # An Arrow table becomes a local relation, whose size the join knows.
    rates = pa.table({"of": pa.array([r[0] for r in counts]), "rate": pa.array([each / r[1] for r in counts], pa.float64())})
    rates = rows.sparkSession.createDataFrame(rates)
    drawn = rows.withColumn("draw", unit_draw(F.col("doc_id"), seed)).join(rates, F.col(stratum) == F.col("of")).where("draw < rate").select(rows.columns)
    return sorted(drawn.collect(), key=lambda r: (str(r[stratum]), *map(str, r)))


class _Generation(dict):
    def __init__(self, of: Generations) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, key):
        return self.of.fetch(key)


class Generations:
    """What ``make(key)`` gives, remembered in about ``limit`` bytes.

    Keys are texts, values bytes. Two generations: when the young one is full it becomes the
    old one, whose own predecessor goes; what is met again in the old one moves to the young
    one, so frequent keys stay. A bound on memory alone; it changes no value.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        self.make, self.limit, self.held = make, limit // 2, 0
        self.young, self.old = _Generation(self), {}

    def get(self) -> Callable[[str], bytes]:
        """A fast lookup. Ask for it anew from time to time: it knows the young generation of now."""
        return self.young.__getitem__

    def fetch(self, key: str) -> bytes:
        young = self.young
        if key in young:  # asked through a generation that is no longer the young one
            return young[key]
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        # Two objects and their entry in the table with its free places (measured: 145 bytes beside the content).
        size = 160 + (len(key) if key.isascii() else 4 * len(key)) + len(value)
        if size < self.limit:
            if self.held + size > self.limit:
                self.old, self.young, self.held = young, _Generation(self), 0
            self.held += size
            self.young[key] = value
        return value


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def map_texts(docs: DataFrame, make: Callable[[], Callable], out: str, carry: tuple[str, ...] = ("doc_id",), texts: tuple[str, ...] = ("text",), rows: int = 1024) -> DataFrame:
    """Run a function of texts over all rows, in Arrow batches, without a shuffle.

    ``make()`` is called once per task and returns ``fn(*lists of text)``, which gives one
    list per column of ``out`` ("name type, name type"). The columns in ``carry`` pass
    through untouched. At most ``rows`` rows are worked on at a time. Null texts arrive as
    empty ones unless ``fn`` asks for nulls by an attribute ``nulls = True``.
    """
    fields = [tuple(f.split()) for f in out.split(", ")]
    schema = T.StructType([docs.schema[c] for c in carry] + T.StructType.fromDDL(out).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        nulls = getattr(fn, "nulls", False)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                lists = [batch.column(t).to_pylist() for t in texts]
                made = fn(*(lists if nulls else [[x or "" for x in values] for values in lists]))
                arrays = [batch.column(c) for c in carry] + [v if isinstance(v, pa.Array) else pa.array(v, ARROW[t]) for v, (_, t) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *(n for n, _ in fields)])

    return docs.select(*dict.fromkeys([*carry, *texts])).mapInArrow(run, schema)

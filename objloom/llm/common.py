"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: lower-cased ASCII letters and digits, and everything outside ASCII.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def canonical_words(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(WORD_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str):
    """A column by its exact name, also one with dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/objloom-shared")
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def sampled_texts(docs: DataFrame, text_col: str, rows: int, text_bytes: int = 16_384) -> list[str]:
    """Some ``rows`` different whole texts of at most ``text_bytes`` bytes, for what only saves work (caches, dictionaries).

    Those whose hash is under the share wanted, from all partitions; copies of
    a text pass together and are one, combined before they move.
    """
    texts = docs.select(column(text_col).alias("t")).where(F.octet_length("t") <= text_bytes)
    n = texts.count()
    passed = texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 40)) / float(1 << 40) < min(1.0, rows / max(1, n))).groupBy("t").count()
    return passed.select("t").sort("t").toArrow()["t"].to_pylist()


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names (in any case) renamed ``input_<name>``, so none is lost, and the new name of each column."""
    taken, out, clash = {c.lower() for c in docs.columns}, {}, {n.lower() for n in names}
    for c in docs.columns:
        new = c
        while new.lower() in clash or new != c and new.lower() in taken:
            new = f"input_{new}"
        taken.add(new.lower())
        out[c] = new
    return docs.select(*[column(c).alias(n) for c, n in out.items()]), out


def plainly(docs: DataFrame, use: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """use(docs under names that no operator has, the new name of each column), with the columns and names of docs."""
    names = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    made = use(docs.select(*[column(c).alias(n) for c, n in names.items()]), names)
    return made.select(*[F.col(n).alias(c) for c, n in names.items()])


def appended(docs: DataFrame, fields: list[T.StructField], make: Callable[[str], Callable[[pa.RecordBatch], list]], reads: str) -> DataFrame:
    """docs with columns appended by an Arrow function.

    ``make(name)`` runs once in each task and gives a function from a record
    batch to one list (or Arrow array) for each field; name is that of the text
    column ``reads``, which must exist.  Columns of docs that have the name of
    a field are kept as ``input_<name>``.
    """
    docs[f"`{reads}`"]  # fails here, not in a task
    docs, names = set_aside(docs, [f.name for f in fields])
    # mapInArrow resolves names itself, so dots must not be in them
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    made = [T.StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)]
    schema = T.StructType([*plain.schema.fields, *made])
    text, out = f"c{docs.columns.index(names[reads])}", [*docs.columns, *(f.name for f in fields)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work = make(text)
        kinds = [to_arrow_type(f.dataType) for f in fields]
        for b in batches:
            if b.num_rows:
                got = work(b)
                new = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(got, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*out)


def held_out(column: str, parts: int, part: int):
    """True where crc32(the id as text) mod parts is part; false without an id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))


def trained(samples: list[bytes], size: int, **options) -> bytes:
    """A zstandard dictionary trained on samples; where there are too few to train on, the samples, the most frequent last, as many as there is room for."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, **options).as_bytes()
    except z.ZstdError:
        out, room = [], size
        for s, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])):
            if len(s) <= room:
                out.append(s)
                room -= len(s)
        return b"".join(out[::-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights (bias last) of a logistic regression with a ridge penalty, both classes weighted alike, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pos = max(1, int(y.sum()))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / max(1, len(y) - pos)) * len(y)
    penalty = ridge * np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def least_hashed(rows: DataFrame, key: str, per_key: int, id_col: str) -> DataFrame:
    """Rows whose id's hash (``_h``) is under twice the share wanted of their key, found without moving a row.

    About 2 * per_key distinct ids of a key at most.  A first pass counts keys;
    their shares, a row for each class or language, are broadcast.
    """
    hashed = rows.withColumn("_h", F.xxhash64(id_col))
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).toArrow()
    if not counts.num_rows:
        return hashed.limit(0)
    share = F.broadcast(rows.sparkSession.createDataFrame(counts).select(F.col(key), F.least(F.lit(1.0), 2.0 * per_key / F.col("_n")).alias("_share")))
    return hashed.join(share, key).where((F.pmod(F.col("_h"), F.lit(1 << 40)) / float(1 << 40)) < F.col("_share")).drop("_share")


#: Bounds of a fitting sample: bytes of a text, and of all texts of a class.
TEXT_BYTES, CLASS_BYTES = 65_536, 8 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", text_bytes: int = TEXT_BYTES, class_bytes: int = CLASS_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample of labelled rows, for fitting.

    Only rows whose crc32(id as text) mod 3 is not 1; ids with contradicting
    labels or no label are left out, and of repeated ids the least text counts.
    Texts of at most ``text_bytes`` bytes are taken in the order of their id's
    hash, until a class has ``per_class`` rows or ``class_bytes`` bytes, so
    the sample is the same on every run and what comes to the driver is bounded
    in rows and bytes at any corpus size.
    """
    rows = (
        labels.select(column(id_col).alias("_id"), column(label).cast("int").alias("_y"))
        .where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id", 3, 1))
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    )
    passed = least_hashed(rows, "_y", per_class, "_id").toArrow()  # some 4 * per_class ids
    if not passed.num_rows:
        return [], []
    spark = docs.sparkSession
    texts = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text")).where("_text IS NOT NULL")
    texts = texts.join(F.broadcast(spark.createDataFrame(passed)), "_id").groupBy("_id", "_h", "_y").agg(F.min("_text").alias("_text"))
    left = {0: [per_class, class_bytes], 1: [per_class, class_bytes]}
    picked = []
    sizes = texts.select("_id", "_h", "_y", F.octet_length("_text").alias("_size")).where(F.col("_size") <= text_bytes).toArrow().to_pylist()
    for r in sorted(sizes, key=lambda r: (r["_h"], r["_id"])):
        room = left[r["_y"]]
        if room[0] and r["_size"] <= room[1]:
            picked.append(r["_id"])
            room[0], room[1] = room[0] - 1, room[1] - r["_size"]
    if not picked:
        return [], []
    chosen = spark.createDataFrame([(i,) for i in picked], docs.select(column(id_col).alias("_id")).schema)
    got = texts.join(F.broadcast(chosen), "_id", "left_semi").select("_id", "_y", "_text").toArrow().sort_by("_id")
    return got["_text"].to_pylist(), got["_y"].to_pylist()

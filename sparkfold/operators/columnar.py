"""Columnar encodings of semi-structured rows: schema inference, transposition, deltas, varints, dictionaries, bit packs.

Orders that span the whole table are kept without a single-partition window: rows are
range partitioned and checkpointed, each partition is windowed on its own, and one row
a partition carries the state over its boundary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.functions.lineage import cut, sized

SAMPLE, UNIFORM = 100, 0.9
TYPES = ("int", "float", "str", "bool")
SPARK_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType()}


def infer_schema(rows: DataFrame, pos: str = "pos", json: str = "json", sample: int | None = SAMPLE, uniform: float = UNIFORM) -> DataFrame:
    """(key, n_present, dominant_type, kept) of the keys of the rows with pos < sample, or of all rows; values of other types count as str, nulls as nothing."""
    head = (rows if sample is None else rows.where(F.col(pos) < sample)).select(F.parse_json(json).alias("v"))
    keyed = rows.sparkSession.sql("SELECT e.key, schema_of_variant(e.value) AS t FROM {head}, LATERAL variant_explode(v) AS e", head=head)
    kind = F.when(F.col("t") == "VOID", F.lit(None)).when(F.col("t") == "BOOLEAN", "bool").when(F.col("t") == "BIGINT", "int").when(F.col("t").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float").otherwise("str")
    counts = keyed.select("key", kind.alias("k")).groupBy("key").agg(F.count(F.lit(1)).alias("n_present"), *[F.count(F.when(F.col("k") == t, 1)).alias(f"_{t}") for t in TYPES])
    most = F.greatest(*[F.col(f"_{t}") for t in TYPES])
    dominant = F.coalesce(*[F.when(F.col(f"_{t}") == most, F.lit(t)) for t in TYPES])
    total = head.agg(F.count(F.lit(1)).alias("_rows"))  # one row
    return counts.crossJoin(total).select("key", "n_present", dominant.alias("dominant_type"), (F.col("n_present") >= uniform * F.col("_rows")).alias("kept"))


def uniformity(schema: DataFrame, uniform: float = UNIFORM) -> DataFrame:
    """(all_keys, kept_keys, is_uniform): whether enough keys are regular for a columnar form."""
    n = schema.agg(F.count(F.lit(1)).alias("all_keys"), F.count(F.when(F.col("kept"), 1)).alias("kept_keys"))
    return n.withColumn("is_uniform", (F.col("all_keys") > 0) & (F.col("kept_keys") >= uniform * F.col("all_keys")))


def to_columns(rows: DataFrame, schema: dict[str, str], pos: str = "pos", json: str = "json", rest: str | None = None) -> DataFrame:
    """One typed column for each key of ``schema`` {key: int, float, str or bool}; ``bad_values`` counts values of another type, which become null.

    ``rest`` names a column for what the typed columns don't hold, as a JSON object:
    all other keys, and the values of another type; null where there is nothing.
    """
    if not schema:
        left = [F.when(F.col(json) != "{}", F.col(json)).alias(rest)] if rest else []
        return rows.select(pos, F.lit(0).alias("bad_values"), *left)
    typed = F.from_json(json, T.StructType([T.StructField(k, SPARK_TYPES[t]) for k, t in schema.items()]))
    raw = F.from_json(json, T.StructType([T.StructField(k, T.StringType()) for k in schema]))
    every = [F.from_json(json, "map<string,variant>").alias("m")] if rest else []
    both = rows.select(pos, typed.alias("t"), raw.alias("r"), *every)
    bad = sum((F.when(F.col("r")[k].isNotNull() & F.col("t")[k].isNull(), 1).otherwise(0) for k in schema), F.lit(0))
    if not rest:
        return both.select(pos, "t.*", bad.alias("bad_values"))
    held = F.array_compact(F.array(*[F.when(F.col("r")[k].isNull() | F.col("t")[k].isNotNull(), F.lit(k)) for k in schema]))
    left = F.map_filter("m", lambda k, _: ~F.array_contains(held, k))
    return both.select(pos, "t.*", bad.alias("bad_values"), F.when(F.size(left) > 0, F.to_json(left)).alias(rest))


def ordered(rows: DataFrame, by: str) -> DataFrame:
    """The rows range partitioned by ``by``, with the partition as ``_p``; fixed by a checkpoint, since ranges are sampled."""
    return cut(rows.repartitionByRange(by).withColumn("_p", F.spark_partition_id()))


def _carried(parts: DataFrame, value: Column, name: str) -> DataFrame:
    """(_p, name): what the partitions before give; parts has a row for each partition."""
    return sized(cut(parts.select("_p", value.alias(name))))


def with_previous(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Adds ``previous``: the column's value in the row before, null in the first; ``by`` orders the whole table."""
    spread = ordered(rows, by)
    last = spread.groupBy("_p").agg(F.max_by(column, by).alias("_last"))
    before = _carried(last, F.lag("_last").over(Window.orderBy("_p")), "_before")
    inside = F.lag(column).over(Window.partitionBy("_p").orderBy(by))
    first = F.row_number().over(Window.partitionBy("_p").orderBy(by)) == 1
    return spread.withColumn("_in", inside).withColumn("_first", first).join(before, "_p").select(*rows.columns, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_in")).alias("previous"))


def with_running_sum(rows: DataFrame, column: str, by: str, name: str = "running") -> DataFrame:
    """Adds the sum of the column up to and with each row."""
    spread = ordered(rows, by)
    totals = spread.groupBy("_p").agg(F.sum(column).alias("_sum"))
    before = _carried(totals, F.coalesce(F.sum("_sum").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_base")
    inside = F.sum(column).over(Window.partitionBy("_p").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return spread.withColumn("_in", inside).join(before, "_p").select(*rows.columns, (F.col("_base") + F.col("_in")).alias(name))


def with_position(rows: DataFrame, by: str, name: str = "position") -> DataFrame:
    """Adds the 0-based position in the order of ``by``."""
    counted = with_running_sum(rows.withColumn("_one", F.lit(1).cast("long")), "_one", by, name)
    return counted.withColumn(name, F.col(name) - 1).drop("_one")


def int_delta(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Adds d: the difference to the row before; the first row's is its value."""
    return with_previous(rows, column, by).withColumn("d", F.col(column) - F.coalesce("previous", F.lit(0))).drop("previous")


def zigzag(d: Column) -> Column:
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


def varint_length(z: Column) -> Column:
    """Bytes of the unsigned LEB128 form of a 64-bit pattern."""
    out = F.when(z < 0, 10)
    for n in range(1, 10):
        out = out.when(z < (1 << 7 * n), n) if n < 9 else out.otherwise(9)
    return out


def varint_hex(z: Column) -> Column:
    """The LEB128 bytes as hex."""
    one = F.array(F.struct(z.alias("_z"), varint_length(z).alias("_n")))  # binds z once for the inner lambda
    return F.element_at(F.transform(one, lambda s: F.array_join(F.transform(F.sequence(F.lit(0), s["_n"] - 1), lambda k: _byte(s, k)), "")), 1)


def _byte(s: Column, k: Column) -> Column:
    low = F.call_function("shiftrightunsigned", s["_z"], k * 7).bitwiseAND(F.lit(127).cast("long"))
    return F.lpad(F.hex(low.bitwiseOR(F.when(k < s["_n"] - 1, F.lit(128)).otherwise(F.lit(0)).cast("long"))), 2, "0")


@F.arrow_udf(T.ArrayType(T.LongType()))
def varint_decode(data: pa.Array) -> pa.Array:
    """All numbers of a LEB128 byte string, zigzag taken back; null if it ends inside one."""
    out = []
    for v in data:
        if not v.is_valid:
            out.append(None)
            continue
        b = np.frombuffer(v.as_buffer(), np.uint8).astype(np.uint64)
        ends = np.flatnonzero(b < 128)
        if len(b) and (not len(ends) or ends[-1] != len(b) - 1):
            out.append(None)
            continue
        starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
        shift = (np.arange(len(b)) - np.repeat(starts, ends - starts + 1)) * 7 if len(b) else np.zeros(0)
        z = np.add.reduceat((b & np.uint64(127)) << shift.astype(np.uint64), starts) if len(b) else np.zeros(0, np.uint64)
        out.append(((z >> np.uint64(1)).astype(np.int64)) ^ -((z & np.uint64(1)).astype(np.int64)))
    return pa.array(out, pa.list_(pa.int64()))


def dictionary(rows: DataFrame, column: str, by: str) -> DataFrame:
    """(value, code): distinct values in the order in which they first appear; null is a value."""
    first = rows.groupBy(F.col(column).alias("value")).agg(F.min(by).alias("_at"))
    return with_position(first, "_at", "code").select("value", "code")


def dict_encode(rows: DataFrame, column: str, by: str) -> DataFrame:
    """(by, value, code) of every row. The dictionary is broadcast if it is small enough."""
    words = sized(cut(dictionary(rows, column, by))).withColumnRenamed("value", "_v")
    return rows.select(by, F.col(column).alias("value")).join(words, F.col("value").eqNullSafe(F.col("_v"))).select(by, "value", "code")


def bit_pack(rows: DataFrame, flag: Column, pos: str = "pos") -> DataFrame:
    """(group, bits): eight flags a byte, the first one lowest; null flags are 0."""
    bit = F.call_function("shiftleft", F.coalesce(flag, F.lit(False)).cast("int"), (F.col(pos) % 8).cast("int"))
    return rows.groupBy(F.expr(f"{pos} div 8").alias("group")).agg(F.sum(bit).cast("int").alias("bits"))


def bit_unpack(packed: DataFrame) -> DataFrame:
    """(pos, flag) of packed groups, eight for each."""
    each = packed.select("group", "bits", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_i"))
    return each.select((F.col("group") * 8 + F.col("_i")).alias("pos"), (F.call_function("shiftright", F.col("bits"), F.col("_i")).bitwiseAND(F.lit(1)) == 1).alias("flag"))


@F.arrow_udf(T.BinaryType())
def pack_doubles(values: pa.Array) -> pa.Array:
    """An array of doubles as big-endian IEEE 754."""
    return pa.array([np.asarray(v.as_py(), ">f8").tobytes() if v.is_valid else None for v in values], pa.binary())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def unpack_doubles(values: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(v.as_buffer(), ">f8").astype(float) if v.is_valid else None for v in values], pa.list_(pa.float64()))

"""Record validation: typed rows out of payloads, bad rows set aside with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.dates import to_utc
from tidegauge.functions.jsonfields import is_json
from tidegauge.session import spread
from tidegauge.sources import schemas

_CORRUPT = "_corrupt"
# JSON types of fields as the variant parser names them; an absent field has none.
_TEXT, _NULL = "STRING", "VOID"


def _as_text(schema: T.StructType) -> T.StructType:
    """The same fields with text leaves, so that a wrong type is seen, not lost."""
    fields = [
        T.StructField(
            f.name,
            T.ArrayType(T.StringType()) if isinstance(f.dataType, T.ArrayType) else T.StringType(),
        )
        for f in schema
    ]
    return T.StructType(fields + [T.StructField(_CORRUPT, T.StringType())])


def _whole_number(text: Column) -> Column:
    """``7``, ``"7"`` and ``7.0`` are whole numbers; ``7.5`` is not."""
    decimal = text.try_cast("decimal(38,9)")
    return F.coalesce(
        text.try_cast("bigint"), F.when(decimal == F.floor(decimal), decimal.try_cast("bigint"))
    )


def _typed(raw: Column, field: T.StructField) -> Column:
    value = raw.getField(field.name)
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(
            F.transform(value, _whole_number), F.array().cast(field.dataType)
        )
    if isinstance(field.dataType, T.TimestampType):
        return to_utc(value)
    if isinstance(field.dataType, T.BooleanType):
        return F.coalesce(value.try_cast("boolean"), F.lit(False))
    if isinstance(field.dataType, T.LongType):
        return _whole_number(value)
    return value


def _kind(document: Column, name: str) -> Column:
    """The JSON type of a field; tells a null from an absent field and text from the rest."""
    return F.schema_of_variant(F.try_variant_get(document, f"$.{name}", "variant"))


def _wrong_text(document: Column, name: str) -> Column:
    """True for a text field that holds a number, a flag, a list or an object."""
    return F.coalesce(~_kind(document, name).isin(_TEXT, _NULL), F.lit(False))


def _unreadable(raw: Column, item: Column, document: Column, schema: T.StructType) -> Column:
    """True when an optional field is present but not of its type.

    Lists and flags may be absent, but not null.
    """
    bad = F.lit(False)
    for field in schema:
        value = raw.getField(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.BooleanType)):
            bad = bad | F.coalesce(_kind(document, field.name) == _NULL, F.lit(False))
        elif isinstance(field.dataType, T.StringType):
            bad = bad | _wrong_text(document, field.name)
        if isinstance(field.dataType, T.ArrayType):
            bad = bad | F.coalesce(
                F.exists(item.getField(field.name), lambda x: x.isNull()), F.lit(False)
            )
        elif isinstance(field.dataType, T.BooleanType):
            bad = bad | (value.isNotNull() & value.try_cast("boolean").isNull())
        elif not isinstance(field.dataType, T.StringType):
            bad = bad | (value.isNotNull() & item.getField(field.name).isNull())
    return bad


def _classify(
    df: DataFrame,
    payload: str,
    schema: T.StructType,
    required: list[str],
    extra: list[tuple[Column, str]],
    partitions: int | None,
    text_times: bool,
) -> DataFrame:
    raw = F.from_json(
        F.col(payload), _as_text(schema), {"columnNameOfCorruptRecord": _CORRUPT}
    )
    # Exploding a one-element array keeps filters on the reason above the parse. Values come
    # from the first parse as text, their JSON types from the second.
    both = F.struct(raw.alias("raw"), F.try_parse_json(F.col(payload)).alias("document"))
    parsed = spread(df, partitions).select("*", F.explode(F.array(both)).alias("_both"))
    parsed = parsed.select("*", F.col("_both.raw").alias("_raw"), F.col("_both.document").alias("_document"))
    staged = parsed.drop("_both").select(
        "*",
        F.struct(*[_typed(F.col("_raw"), f).alias(f.name) for f in schema]).alias("item"),
    )
    reason = F.when(F.col(payload).isNull(), F.lit("missing_payload")).when(
        # from_json stops at the end of the first document; is_json sees what follows.
        F.col("_raw").isNull() | F.col(f"_raw.{_CORRUPT}").isNotNull() | ~is_json(payload),
        F.lit("invalid_json"),
    )
    for name in required:
        reason = reason.when(F.col(f"_raw.{name}").isNull(), F.lit(f"missing_{name}"))
        wrong = F.col(f"item.{name}").isNull()
        if isinstance(schema[name].dataType, T.StringType):
            wrong = wrong | _wrong_text(F.col("_document"), name)
        elif isinstance(schema[name].dataType, T.TimestampType) and not text_times:
            wrong = wrong | F.col(f"_raw.{name}").try_cast("double").isNull()
        reason = reason.when(wrong, F.lit(f"bad_{name}"))
    for condition, label in extra:
        reason = reason.when(condition, F.lit(label))
    unreadable = _unreadable(F.col("_raw"), F.col("item"), F.col("_document"), schema)
    return staged.withColumn("reason", reason.when(unreadable, F.lit("bad_field"))).drop("_raw", "_document")


def classify_items(
    df: DataFrame,
    payload: str = "payload",
    types: list[str] | None = None,
    partitions: int | None = None,
    text_times: bool = True,
) -> DataFrame:
    """Add ``item`` (typed struct) and ``reason`` (null when valid) to each row.

    ``id``, ``type`` and ``time`` are required, the type must be a known tag,
    list fields default to empty and flags to false, unknown fields are ignored. Text
    fields must hold text or null, and neither lists nor flags may be null. Stamps are
    epoch seconds; ``text_times`` also takes date text, as replayed payloads have it.
    """
    known = types or schemas.ITEM_TYPES
    return _classify(
        df,
        payload,
        schemas.ITEM,
        ["id", "type", "time"],
        [(~F.col("item.type").isin(known), "unknown_type")],
        partitions,
        text_times,
    )


def classify_users(
    df: DataFrame, payload: str = "payload", partitions: int | None = None, text_times: bool = True
) -> DataFrame:
    """As ``classify_items`` for user records: ``id``, ``created``, ``karma`` required."""
    return _classify(df, payload, schemas.USER, ["id", "created", "karma"], [], partitions, text_times)


def split_valid(classified: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good, bad): typed columns of the valid rows; payload and reason of the others."""
    good = classified.filter(F.col("reason").isNull()).select("item.*")
    bad = classified.filter(F.col("reason").isNotNull()).select(payload, "reason")
    return good, bad


def validate_items(
    df: DataFrame, payload: str = "payload", types: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    return split_valid(classify_items(df, payload, types), payload)


def validate_users(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    return split_valid(classify_users(df, payload), payload)


def _blank(col: Column) -> Column:
    return F.coalesce(F.length(col) == 0, F.lit(True))


def term_violations(df: DataFrame) -> DataFrame:
    """Listed terms with an empty key, name or category."""
    return df.filter(_blank(F.col("key")) | _blank(F.col("name")) | _blank(F.col("category")))


def series_violations(df: DataFrame, key: str = "tech_key", name: str = "name") -> DataFrame:
    """Series whose shape is wrong: blank key or name, malformed month, negative count."""
    points_ok = F.forall(
        "data",
        lambda p: F.coalesce(
            p["month"].rlike(r"^[0-9]{4}-[0-9]{2}\z") & (p["count"] >= 0), F.lit(False)
        ),
    )
    return df.filter(
        _blank(F.col(key)) | _blank(F.col(name)) | ~F.coalesce(points_ok, F.lit(False))
    )

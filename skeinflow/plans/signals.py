"""Queries over audio blocks and settings records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, jstext, settings
from .inputs import blocks, sql, table

#: A rate whose ratio to the output rate is no whole number.
ODD_RATE = 44_100


def _samples(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.posexplode("pcm").alias("pos", "sample")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("sample").cast("long").alias("sample"))


def pcm16_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks from 48 to 16 kHz."""
    return _samples(blocks(spark, sf_dir).select("vec_id", audio.capture(F.col("samples")).alias("pcm")))


def pcm16_worklet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks from 44.1 to 16 kHz by the other variant."""
    return _samples(blocks(spark, sf_dir).select("vec_id", audio.worklet(F.col("samples"), ODD_RATE).alias("pcm")))


def pcm_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled blocks as bytes in hexadecimal, and whether reading these gives the block again."""
    rows = blocks(spark, sf_dir).select("vec_id", audio.capture(F.col("samples")).alias("pcm")).withColumn("data", audio.to_bytes(F.col("pcm")))
    return rows.select("vec_id", F.hex("data").alias("data"), audio.from_bytes(F.col("data")).eqNullSafe(F.col("pcm")).alias("same"))


_INF, _NAN = float("inf"), float("nan")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _by(forms: list[Column]) -> Column:
    """One of the forms by the event's number."""
    n = F.col("event_id")
    got = F.when(n % len(forms) == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        got = got.when(n % len(forms) == i, form)
    return got


def overlay_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of any numbers, made of the events' values, as they are accepted."""
    v, none = F.col("value"), F.lit(None).cast("double")
    fields = [_by([v, -v, F.lit(_NAN), F.lit(_INF), none]), _by([F.lit(-_INF), v, none]), _by([v * 10, F.lit(200.0), F.lit(200.5), F.lit(_NAN)]), _by([v * 5, F.lit(140.0), F.lit(141.0), F.lit(_INF), none]), _by([v / 50, F.lit(0.2), F.lit(1.0), F.lit(1.01), F.lit(_NAN), F.lit(0.19)])]
    rows = _events(spark, sf_dir).select("event_id", F.struct(*[f.alias(n) for n, f in zip(settings.OVERLAY, fields, strict=True)]).alias("o"))
    return rows.select("event_id", settings.checked(F.col("o")).alias("o")).select("event_id", "o.*")


def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default window with some fields, made of the events' values, patched."""
    v, none = F.col("value"), F.lit(None).cast("double")
    patch = F.struct(*[F.when(F.col("event_id") % (i + 2) == 0, v + i).otherwise(none).alias(n) for i, n in enumerate(settings.OVERLAY)])
    stored = F.struct(*[F.lit(x).alias(k) for k, x in settings.OVERLAY.items()])
    return _events(spark, sf_dir).select("event_id", settings.merged(stored, patch).alias("o")).select("event_id", "o.*")


def key_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys, encrypted, empty, missing and broken, with the environment's."""
    key, n = "0123456789abcdef", F.col("event_id").cast("string")
    value = _by([F.concat(F.lit("s"), n), F.lit(""), F.lit("broken!"), F.lit(""), F.lit(None).cast("string")])
    stored = F.when(F.col("event_id") % 5 == 2, value).otherwise(settings.encrypted(value, key))
    outside = F.when(F.col("event_id") % 5 != 3, F.concat(F.lit("e"), n))
    return _events(spark, sf_dir).select("event_id", settings.resolved(settings.decrypted(stored, key), outside).alias("key"))


def window_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred sizes, made of the events' values, on displays of two sizes."""
    return _events(spark, sf_dir).select("event_id", settings.fitted(F.col("value") * 20, _by([F.lit(1920.0), F.lit(300.0)])).alias("size"))


def field_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What text fields, made of the events' numbers, hold as numbers; NaN and infinity as text."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = _by([n, put(" ", n, ".5 "), put("-", n, "e2"), put(n, "d"), kind, put(n, ",5"), put("+.", n), F.lit("Infinity"), F.lit(None).cast("string"), F.lit(""), F.lit(" \t\n"), put("\u00a0", n, "\ufeff")])
    v = jstext.number(text)
    return _events(spark, sf_dir).select("event_id", F.when(F.isnan(v), "NaN").when(v == F.lit(_INF), "Infinity").otherwise("number").alias("kind"), F.when(jstext.finite(v), v).alias("value"))


QUERIES = {f.__name__: f for f in (pcm16_capture, pcm16_worklet, pcm_bytes, overlay_validate, overlay_merge, key_resolution, window_clamp, field_numbers)}

_Q = "trunc(case when c < 0 then c * 32768 else c * 32767 end)::bigint"


def _cases(*forms: str) -> str:
    return f"case event_id % {len(forms)} {' '.join(f'when {i} then {f}' for i, f in enumerate(forms))} end"


_FINE = lambda c: f"{c} is not null and not isnan({c}) and not isinf({c})"
_CAPTURE = "p as (select vec_id, i, ((samples[3 * i + 1]::double + samples[3 * i + 2]::double + samples[3 * i + 3]::double) / 3) as m from (select vec_id, samples, unnest(range(0, len(samples) // 3)) as i from blocks)), c as (select vec_id, i, greatest(-1, least(1, m)) as c from p)"

_NAN_SQL, _INF_SQL = "'nan'::double", "'inf'::double"
KEYS = ["'s' || event_id", "'e' || event_id", "'e' || event_id", "''", "'e' || event_id"]

SQL = {
    "pcm16_capture": sql(f", {_CAPTURE} select vec_id, i as pos, {_Q} as sample from c", "blocks"),
    "pcm16_worklet": sql(f", b as (select vec_id, samples, unnest(range(0, floor(len(samples) / 2.75625)::bigint)) as i from blocks), e as (select *, floor(i * 2.75625::double + 0.5)::bigint as a, least(len(samples), floor((i + 1) * 2.75625::double + 0.5)::bigint) as z from b), m as (select vec_id, i, (list_reduce(list_prepend(0::double, list_transform(samples[a + 1:z], lambda x: x::double)), lambda x, y: x + y) / (z - a))::float as m from e), c as (select vec_id, i, greatest(-1, least(1, m::double)) as c from m) select vec_id, i as pos, {_Q} as sample from c", "blocks"),
    "pcm_bytes": sql(f", {_CAPTURE}, q as (select vec_id, i, {_Q} as s from c), h as (select vec_id, i, (s + 65536) % 65536 as u from q) select vec_id, string_agg(printf('%02X%02X', u % 256, u // 256), '' order by i) as data, true as same from h group by vec_id", "blocks"),
    "overlay_validate": f"with o as (select event_id, {_cases('value', '-value', _NAN_SQL, _INF_SQL, 'null')} as x, {_cases('-' + _INF_SQL, 'value', 'null')} as y, {_cases('value * 10', '200', '200.5', _NAN_SQL)} as width, {_cases('value * 5', '140', '141', _INF_SQL, 'null')} as height, {_cases('value / 50', '0.2', '1', '1.01', _NAN_SQL, '0.19')} as opacity from events) select event_id, case when {_FINE('x')} then x else 40 end as x, case when {_FINE('y')} then y else 40 end as y, case when {_FINE('width')} and width > 200 then width else 540 end as width, case when {_FINE('height')} and height > 140 then height else 420 end as height, case when {_FINE('opacity')} and opacity between 0.2 and 1 then opacity else 0.94 end as opacity from o",
    "overlay_merge": "select event_id, " + ", ".join(f"case when event_id % {i + 2} = 0 then value + {i} else {d}::double end as {n}" for i, (n, d) in enumerate(settings.OVERLAY.items())) + " from events",
    "key_resolution": f"select event_id, {_cases(*KEYS)} as key from events",
    "window_clamp": f"select event_id, least(value * 20, {_cases('1920', '300')}::double) as size from events",
    "field_numbers": f"select event_id, {_cases(*['\'number\''] * 3, *['\'NaN\''] * 3, '\'number\'', '\'Infinity\'', *['\'number\''] * 4)} as kind, {_cases('event_id', 'event_id + 0.5', '-100.0 * event_id', 'null', 'null', 'null', '(chr(46) || event_id)::double', 'null', '0', '0', '0', 'event_id')}::double as value from events",
}

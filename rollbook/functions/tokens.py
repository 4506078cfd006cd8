"""Login tokens, request signatures, expiry texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS_PER_DAY = 24 * 60 * 60


def make_token(identity: Column, user_uid: Column, now: Column, days: int, salt: str) -> Column:
    """``identity:uid:expiry:digest`` with the expiry in epoch seconds."""
    expiry = (now.cast("bigint") + days * SECONDS_PER_DAY).cast("string")
    parts = [identity, user_uid.cast("string"), expiry]
    return F.concat_ws(":", *parts, F.md5(F.concat_ws(":", *parts, F.lit(salt))))


def token_audit(df: DataFrame, now: int, salt: str, token: str = "token") -> DataFrame:
    """Token parts, a verdict (``ok``, ``malformed``, ``expired``) and whether the digest matches.

    The verdict does not depend on the digest; the flag shows which accepted tokens were made up.
    """
    parts = F.split(F.col(token), ":", -1)
    four = F.size(parts) == 4

    def part(i: int) -> Column:
        return F.when(four, F.get(parts, F.lit(i)))

    df = df.withColumns({"identity": part(0), "user_uid": part(1), "_expiry": part(2), "_digest": part(3)})
    filled = F.lit(True)
    for name in ("identity", "user_uid", "_expiry", "_digest"):
        filled = filled & (F.col(name) != "")
    expiry = F.col("_expiry").try_cast("decimal(38,0)")
    verdict = (
        F.when(~F.coalesce(filled, F.lit(False)) | expiry.isNull(), "malformed")
        .when(expiry > now, "ok")
        .otherwise("expired")
    )
    digest = F.md5(F.concat_ws(":", "identity", "user_uid", "_expiry", F.lit(salt)))
    return (
        df.withColumn("expiry", expiry.try_cast("bigint"))
        .withColumn("verdict", verdict)
        .withColumn("digest_ok", F.coalesce(F.col("_digest") == digest, F.lit(False)))
        .drop("_expiry", "_digest")
    )


def sign_params(params: Column, sign: Column, stime: Column) -> Column:
    """Signature of a ``map<string,string>`` of request parameters.

    Parameters without a value are left out, the rest is joined as ``,KEY=VALUE`` in upper case with
    the keys in descending order.
    """
    filled = F.filter(
        F.map_entries(params), lambda e: e["value"].isNotNull() & (e["value"] != "")
    )
    pairs = F.transform(
        F.sort_array(filled, asc=False),
        lambda e: F.concat(F.lit(","), F.upper(e["key"]), F.lit("="), F.upper(e["value"])),
    )
    return F.md5(F.concat(stime, F.md5(F.array_join(pairs, "")), sign))


def expiry_strings(
    ts: Column, seconds: Column, fmt: str = "yyyyMMddHHmmss"
) -> tuple[Column, Column]:
    """A moment and the moment so many seconds later, both as text."""
    zero = F.lit(0)
    later = ts + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))
    return F.date_format(ts, fmt), F.date_format(later, fmt)

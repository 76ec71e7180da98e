"""The settings record: defaults, checks, merging, keys that are kept encrypted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jstext

# The window's defaults and limits.
OVERLAY = {"x": 40.0, "y": 40.0, "width": 540.0, "height": 420.0, "opacity": 0.94}
ABOVE = {"width": 200.0, "height": 140.0}
OPACITY = (0.2, 1.0)


def checked(overlay: Column) -> Column:
    """Of a struct of five numbers each as it is if finite and in range, else its default."""

    def one(name: str) -> Column:
        v = overlay[name].cast("double")
        fits = jstext.finite(v)
        if name in ABOVE:
            fits = fits & (v > ABOVE[name])
        if name == "opacity":
            fits = fits & v.between(*OPACITY)
        return F.when(fits, v).otherwise(F.lit(OVERLAY[name])).alias(name)

    return F.struct(*[one(n) for n in OVERLAY])


def merged(stored: Column, patch: Column) -> Column:
    """The stored struct with the patch's fields that are not null."""
    return F.struct(*[F.coalesce(patch[n], stored[n]).alias(n) for n in OVERLAY])


def fitted(preferred: Column, display: Column) -> Column:
    """A width or height that the display can hold."""
    return F.least(preferred, display)


def encrypted(value: Column, key: str | None) -> Column:
    """Base64 of the encrypted value; the value itself without a key; empty and null give the empty text."""
    kept = F.base64(F.aes_encrypt(value.cast("binary"), F.lit(key.encode()))) if key else value
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(kept)


def decrypted(value: Column, key: str | None) -> Column:
    """The other way; what cannot be decrypted gives the empty text."""
    got = F.coalesce(F.try_aes_decrypt(F.try_to_binary(value, F.lit("base64")), F.lit(key.encode())).cast("string"), F.lit("")) if key else value
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(got)


def resolved(stored: Column, environment: Column) -> Column:
    """The stored key unless it is empty, else the environment's, else the empty text."""
    return F.coalesce(jstext.present(stored), environment, F.lit(""))

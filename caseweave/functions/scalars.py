"""Column expressions shared by the operators; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a refusal.
REFUSAL_MARKERS = ["i can't help", "i cannot help", "i can’t help", "i cannot assist",
                   "i can't assist", "i won’t provide", "i won't provide",
                   "not able to provide", "can't provide instructions", "cannot provide instructions"]


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(x) -> Column:
    """A flag that is set; missing counts as not set."""
    return F.coalesce(c(x).cast("boolean"), F.lit(False))


def blank(x) -> Column:
    """Missing or empty."""
    return c(x).isNull() | (c(x) == "")


def present(x) -> Column:
    return c(x).isNotNull() & (c(x) != "")


def iso_ts(x) -> Column:
    """ISO-8601 text to timestamp, NULL when it does not parse."""
    return F.try_to_timestamp(c(x))


def origin(url) -> Column:
    """``scheme://authority`` of a URL, NULL when either part is missing."""
    u = c(url)
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)"
    scheme = F.lower(F.regexp_extract(u, pattern, 1))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), F.regexp_extract(u, pattern, 2)))


def hostname(url) -> Column:
    """Lower-case host of a URL without user info and port."""
    h = F.lower(F.regexp_extract(c(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]+)", 1))
    return F.when(h != "", F.regexp_replace(h, r"[\[\]]", ""))


def registrable(host) -> Column:
    """Approximate registrable domain: the last two labels."""
    return F.substring_index(F.lower(F.trim(c(host), F.lit("."))), ".", -2)


def entropy(text) -> Column:
    """Shannon entropy in bits per character.

    Each distinct character is counted by removing it from the text, so the
    text is split only once.
    """
    s = c(text)
    n = F.char_length(s).cast("double")
    distinct = F.array_distinct(F.filter(F.split(s, ""), lambda x: x != ""))
    shares = F.transform(distinct, lambda ch: (F.char_length(s) - F.char_length(F.replace(s, ch, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(0.0)


def looks_like_refusal(text) -> Column:
    low = F.lower(c(text))
    hit = F.lit(False)
    for marker in REFUSAL_MARKERS:
        hit = hit | F.contains(low, F.lit(marker))
    return hit


def contains_any(text: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(text, F.lit(n))
    return hit


def sorted_array(x: Column) -> Column:
    return F.array_sort(x)


def epoch_ms(ts) -> Column:
    return F.unix_millis(c(ts).cast("timestamp"))


def digest_of(variant: Column) -> Column:
    """SHA-256 of JSON with sorted keys and no whitespace."""
    return F.sha2(F.to_json(variant), 256)


def tri_state(doc: str, field: str) -> Column:
    """``absent``, ``null`` or ``present`` for a top-level field of a JSON text column."""
    keys = F.json_object_keys(doc)
    value = F.try_variant_get(F.try_parse_json(F.col(doc)), f"$.{field}", "variant")
    return (F.when(~F.coalesce(F.array_contains(keys, field), F.lit(False)), "absent")
            .when(value.isNull() | F.is_variant_null(value), "null").otherwise("present"))


def jwt_claims(token, schema: str) -> Column:
    """Decoded (not verified) claims of a JSON web token."""
    body = F.translate(F.split(c(token), r"\.").getItem(1), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), schema)


# Component labels by name fragment; the first fragment found wins.
COMPONENTS = [("embed", "embedding"), ("lm_head", "lm_head"), ("vision", "vision"), ("mlp", "mlp"),
              ("ffn", "ffn"), ("linear_attn", "linear_attention"), ("linear_attention", "linear_attention"),
              ("self_attn", "attention"), ("attention", "attention"), ("norm", "norm"), ("mtp", "mtp")]


def tensor_layer(name) -> Column:
    """Layer number in a tensor name, NULL when it names none."""
    n = F.regexp_extract(c(name), r"(?:layers|layer)\.(\d+)\.", 1)
    return F.when(n != "", n.cast("int"))


def tensor_component(name) -> Column:
    low = F.lower(c(name))
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in COMPONENTS], F.lit("other"))

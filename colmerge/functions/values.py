"""Values: SQL literals and JSON text, write statements by kind, keys, hex, and keyed digests. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # bytes of a SHA-256 block


def literal_to_json(text: Column) -> Column:
    """A SQL literal as JSON text: null, quoted string (doubled quotes halved), whole number, number, true/false, else the raw text as a string."""
    t = F.trim(text)
    upper = F.upper(t)

    def quoted(s: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    string = F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'"))
    whole = t.rlike(r"^[+-]?[0-9]+$") & t.try_cast("bigint").isNotNull()
    return (
        F.when(upper == "NULL", F.lit("null"))
        .when(t.rlike(r"(?s)^'.*'$") & (F.length(t) > 1), quoted(string))
        .when(whole, t.try_cast("bigint").cast("string"))
        .when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double").cast("string"))
        .when(upper.isin("TRUE", "FALSE"), F.lower(t))
        .otherwise(quoted(t))
    )


def json_kind(val: Column) -> Column:
    """null, boolean, integer, number, string, array or object, for a JSON value's text."""
    t = F.trim(val)
    return (
        F.when(val.isNull() | (t == "null"), "null")
        .when(t.isin("true", "false"), "boolean")
        .when(t.rlike(r"^-?[0-9]+$"), "integer")
        .when(t.rlike(r"^-?[0-9.]+([eE][+-]?[0-9]+)?$"), "number")
        .when(t.startswith('"'), "string")
        .when(t.startswith("["), "array")
        .otherwise("object")
    )


def canonical(val: Column) -> Column:
    """JSON text in the one form that is compared: booleans as 1 and 0, so that both ways of storing them tie."""
    return F.when(val == "true", "1").when(val == "false", "0").otherwise(val)


def bound_value(val: Column) -> Column:
    """What a JSON value stores: booleans as 1 and 0, strings without quotes, arrays and objects as text, null as null."""
    kind = json_kind(val)
    text = F.get_json_object(F.concat(F.lit('{"v":'), val, F.lit("}")), "$.v")
    return F.when(kind == "null", F.lit(None).cast("string")).when(kind == "boolean", canonical(F.trim(val))).when(kind == "string", text).otherwise(F.trim(val))


def write_kind(sql: Column) -> Column:
    """insert, update or delete, by the statement's first words; null for everything else."""
    t = F.upper(F.ltrim(sql))
    return F.when(t.rlike(r"^INSERT\s+(OR\s+\w+\s+)?INTO\s"), "insert").when(t.rlike(r"^UPDATE\s"), "update").when(t.rlike(r"^DELETE\s+FROM\s"), "delete")


def write_table(sql: Column) -> Column:
    """The table that a write names, without quotes; null if it isn't a write."""
    name = F.regexp_extract(sql, r"(?i)^\s*(?:INSERT\s+(?:OR\s+\w+\s+)?INTO|UPDATE(?:\s+OR\s+\w+)?|DELETE\s+FROM)\s+[\"`]?([\w.]+)[\"`]?", 1)
    return F.when(write_kind(sql).isNotNull() & (name != ""), name)


def without_returning(sql: Column) -> Column:
    """A statement without its RETURNING clause."""
    return F.regexp_replace(sql, r"(?is)\s+RETURNING\s.*$", "")


def hex_id(value: Column) -> Column:
    return F.lower(F.hex(value))


def byte_prefix(text: Column) -> Column:
    """The first six bytes of a text as a number: texts in the order of their bytes have numbers in that order."""
    return F.conv(F.rpad(F.substring(F.hex(text), 1, 12), 12, "0"), 16, 10).cast("long")


def same_topic(told: Column, own: Column | str, lenient: bool = True) -> Column:
    """Whether a message belongs to one's topic; a lenient receiver takes one that names none."""
    own = F.lit(own) if isinstance(own, str) else own
    named = F.coalesce(told, F.lit(""))
    return (named == own) | (F.lit(lenient) & (named == ""))


def cell_key(tbl: Column, pk: Column, cid: Column) -> Column:
    return F.concat_ws("|", tbl, pk, cid)


def split_key(key: Column) -> Column:
    """tbl, pk, cid of a key; a ``|`` in the row's key stays with it, as tables and columns have none."""
    parts = F.split(key, r"\|")
    n = F.size(parts)
    return F.struct(parts[0].alias("tbl"), F.array_join(F.slice(parts, F.lit(2), n - 2), "|").alias("pk"), F.element_at(parts, -1).alias("cid"))


def module_prefix(name: Column) -> Column:
    """A crate or package name as a module prefix: dashes to underscores, a trailing ``::*`` dropped."""
    return F.regexp_replace(F.regexp_replace(name, "-", "_"), r"(::\*?)+$", "")


def topic(passphrase: str, name: Column) -> Column:
    """A group's topic: a keyed digest of its name."""
    return mac(passphrase, F.concat(F.lit("topic:"), name))


def mac(passphrase: str, message: Column) -> Column:
    """HMAC-SHA-256 of a text as lowercase hex, from the built-in digest. The reader's semantics, not another digest's bytes."""
    import hashlib

    key = hashlib.sha256(passphrase.encode()).digest().ljust(BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner.hex())), message.cast("binary")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), first), 256)


def verified(passphrase: str, message: Column, tag: Column) -> Column:
    return mac(passphrase, message) == tag


def database_path(url: Column) -> Column:
    """The file behind a database URL, without scheme and parameters; memory databases have none."""
    path = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"\?.*$", "")
    return F.when(F.contains(path, F.lit(":memory:")) | (path == ""), "").otherwise(F.regexp_replace(path, "^//", ""))

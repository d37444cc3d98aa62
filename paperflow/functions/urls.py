"""Addresses of the web in one form: http and https alone, by the parts that a browser reads.

Blanks about an address and line breaks within go; scheme and host are in lower case; any slashes or backslashes may
follow the scheme; the default port goes; segments . and .. are resolved; what may not stand in credentials, path, query
or fragment is percent-encoded as UTF-8. Null is what is no such address: another scheme, no host, a port that is none,
or a host with characters that none has. Hosts that are not ASCII (they need tables of names), numbers that abridge an
IPv4 address, and percent signs in hosts are refused, too. Everything is columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperflow.tables import let

# Ports left out, and what is encoded where, besides controls and all that is not ASCII.
PORTS = {"http": "80", "https": "443"}
FRAGMENT, QUERY, PATH = ' "<>`', " \"#<>'", ' "#<>?`{}'
CREDENTIALS = PATH + "/:;=@[\\]^|"
DOT, DOTS = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
HOST = r"^[^\x00-\x20\x7f-\x{10ffff}#%/:<>?@\[\\\]^|]+$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
ENDS_IN_NUMBER = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"


def encoded(text: Column, reserved: str) -> Column:
    """A text with controls, what is not ASCII and `reserved` characters percent-encoded."""
    bad = "[\\x00-\\x1f\\x7f-\\x{10ffff}" + "".join("\\" + c if c in "\\]^[-" else c for c in reserved) + "]"
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    each = F.array_join(F.transform(F.split(text, "", -1), lambda c: F.when(c.rlike(bad), code(c)).otherwise(c)), "")
    return F.when(text.rlike(bad), each).otherwise(text)


def resolved(path: Column) -> Column:
    """A path without . and .. segments; one that ends in such a segment ends in a slash."""
    none = F.expr("cast(array() as array<string>)")

    def step(parts: Column) -> callable:
        def one(done: Column, x: Column) -> Column:
            last = x["k"] == F.size(parts) - 1
            up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
            ended = lambda a: F.when(last, F.array_append(a, F.lit(""))).otherwise(a)
            return F.when(x["s"].rlike(DOTS), ended(up)).when(x["s"].rlike(DOT), ended(done)).otherwise(F.array_append(done, x["s"]))

        return one

    segments = F.split(F.regexp_replace(path, r"^/", ""), "/", -1)
    return F.concat(F.lit("/"), let(segments, lambda parts: F.array_join(F.aggregate(F.transform(parts, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), none, step(parts)), "/")))


def http_url(text: Column) -> Column:
    """The one form of an address, or null."""
    clean = F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20\x{a0}\x{feff}]+|[\x00-\x20\x{a0}\x{feff}]+$", ""), r"[\t\n\r]", "")

    def parts(t: Column) -> Column:
        group = lambda n: F.regexp_extract(t, r"(?is)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", n)
        return F.struct(F.lower(group(1)).alias("scheme"), group(2).alias("authority"), F.translate(group(3), "\\", "/").alias("path"), group(4).alias("query"), group(5).alias("fragment"))

    def named(x: Column) -> Column:
        found = lambda n: F.regexp_extract(x["authority"], r"(?s)^(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::(.*))?$", n)
        return F.struct(*[x[c].alias(c) for c in ("scheme", "path", "query", "fragment")], found(1).alias("credentials"), F.lower(found(2)).alias("host"), found(3).alias("port"))

    def joined(x: Column) -> Column:
        port = F.regexp_replace(x["port"], "^0+(?=[0-9])", "")
        default = F.when(x["scheme"] == "http", PORTS["http"]).otherwise(PORTS["https"])
        plain = x["host"].rlike(HOST) & (~x["host"].rlike(ENDS_IN_NUMBER) | x["host"].rlike(IPV4))
        good = (x["scheme"] != "") & (plain | x["host"].rlike(r"^\[[0-9a-f:.]+\]$")) & x["port"].rlike(r"^[0-9]*$") & (F.coalesce(port.try_cast("bigint"), F.when(port == "", 0)) <= 65535)
        user = F.regexp_extract(x["credentials"], r"(?s)^([^:]*)", 1)
        word = F.regexp_extract(x["credentials"], r"(?s)^[^:]*:(.*)$", 1)
        who = F.concat(encoded(user, CREDENTIALS), F.when(word != "", F.concat(F.lit(":"), encoded(word, CREDENTIALS))).otherwise(""))
        out = F.concat(
            x["scheme"], F.lit("://"), F.when(who != "", F.concat(who, F.lit("@"))).otherwise(""), x["host"], F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise(""),
            encoded(resolved(x["path"]), PATH), encoded(F.substring(x["query"], 1, 1), ""), encoded(F.substring(x["query"], F.lit(2), F.length(x["query"])), QUERY), F.substring(x["fragment"], 1, 1), encoded(F.substring(x["fragment"], F.lit(2), F.length(x["fragment"])), FRAGMENT),
        )
        return F.when(good, out)

    return let(let(let(clean, parts), named), joined)

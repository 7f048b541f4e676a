"""URL identity: canonical form and item ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, lower case.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "yclid", "msclkid",
    "ref", "ref_src", "ref_url", "spm", "from",
    "share_token", "share_source", "share_from",
    "xsec_token", "xsec_source",
]
#: Fixed value: hosts whose city subdomains of two to four letters show the same pages as www.
CITY_HOSTS = ["huodongxing.com"]


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def decode(part: Column) -> Column:
    """Percent decoding; what cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def encode(part: Column) -> Column:
    """Percent encoding that leaves ~ and escapes *."""
    return F.replace(F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonicalize_url(url: Column, tracking: list[str] | None = None, city_hosts: list[str] | None = None) -> Column:
    """Lower-case scheme and host, no fragment, no tracking or blank parameters, the rest sorted, no slash at the end.

    Null and blank give ''. A missing scheme becomes https; text without // has no host.
    """
    drop = F.array(*[F.lit(p) for p in (TRACKING if tracking is None else tracking)])
    s = strip(F.coalesce(url, F.lit("")))
    # one pass: scheme, host, path, query (RFC 3986, appendix B)
    shape = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

    def part(i: int) -> Column:
        return F.regexp_extract(s, shape, i)

    scheme = F.lower(F.when(part(1) == "", F.lit("https")).otherwise(part(1)))
    host = F.lower(part(3))
    for h in CITY_HOSTS if city_hosts is None else city_hosts:
        host = F.when(host.rlike(r"^[a-z]{2,4}\." + h.replace(".", r"\.") + "$"), F.lit("www." + h)).otherwise(host)
    path = F.when(part(4).isin("", "/"), part(4)).otherwise(F.regexp_replace(part(4), "/+$", ""))
    path = F.when((part(4) != "") & (path == ""), F.lit("/")).otherwise(path)
    pairs = F.transform(
        F.filter(F.split(part(5), "&"), lambda x: x.contains("=") & ~x.endswith("=") | x.rlike("=.*[^=].*=$") | x.rlike("^[^=]*==+$")),
        lambda x: F.struct(decode(F.regexp_extract(x, "^([^=]*)=", 1)).alias("k"), decode(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v")),
    )
    pairs = F.array_sort(F.filter(pairs, lambda p: ~F.array_contains(drop, F.lower(p["k"]))))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    slashes = F.when(part(2) != "", F.lit("//")).otherwise(F.lit(""))
    lead = F.when((part(2) != "") & (path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    whole = F.concat(scheme, F.lit(":"), slashes, host, lead, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(s == "", F.lit("")).otherwise(whole)


def item_id(source_id: Column, url: Column) -> Column:
    """First 16 hex digits of the SHA-256 of source, bar, url."""
    return F.substring(F.sha2(F.concat(source_id.cast("string"), F.lit("|"), url), 256), 1, 16)

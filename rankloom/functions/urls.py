"""URL and host expressions (F1–F5, F19, F21, F27) — built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from ipaddress import IPv6Address

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a visit.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gclid", "gbraid", "wbraid", "fbclid", "msclkid", "mc_cid", "mc_eid", "igshid",
    "ref", "ref_src",
]

# Fixed value: accepted domain names.
DOMAIN_PATTERN = r"(?i)^(?!-)[a-z0-9-]{1,63}(\.[a-z0-9-]{1,63})*\.[a-z]{2,}$"

# RFC 3986, appendix B: scheme, authority, path, query; the fragment is left out.
_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_GAP = "\x01"

MAX_URL_LENGTH = 2000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute a value once and use it in several places of an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tidy(url: Column) -> Column:
    trimmed = F.regexp_replace(url, r"^[\x00-\x20 ]+|[\x00-\x20 ]+$", "")
    return F.regexp_replace(trimmed, r"[\t\r\n]", "")


def _parts(url: Column) -> Column:
    """[scheme, authority, path, query] from a single pass over the URL."""
    return F.split(F.regexp_replace(_tidy(url), _PARTS, f"$1{_GAP}$2{_GAP}$3{_GAP}$4"), _GAP)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(_tidy(url), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def _authority(url: Column) -> Column:
    return F.regexp_extract(_tidy(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def _host_in(authority: Column) -> Column:
    # Up to the port, or what brackets enclose; user information is skipped.
    return F.lower(F.regexp_replace(
        F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1), r"[\[\]]", ""))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty when there is none."""
    return F.coalesce(_host_in(_authority(url)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.element_at(_parts(url), 3)


def _quoted(piece: Column) -> Column:
    """Decode one query piece and encode it again in one canonical spelling."""
    repaired = F.regexp_replace(piece, r"%(?![0-9A-Fa-f]{2})", "%25")
    encoded = F.url_encode(F.url_decode(repaired))
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _canonical_query(query: Column) -> Column:
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(
        _quoted(F.substring_index(p, "=", 1)).alias("key"),
        _quoted(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["key"]).isin(TRACKING_PARAMS))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")


def _query_suffix(query: Column) -> Column:
    # The pair-by-pair rewrite only runs for URLs that carry a query.
    canonical = F.when(query == "", F.lit("")).otherwise(_canonical_query(query))
    return let(canonical, lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)))


def _port_suffix(scheme: Column, port_text: Column) -> Column:
    """``:port``, empty for the default one, null for what is no port."""
    port = port_text.try_cast("int")
    default = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    return (F.when((port_text == "") | default, F.lit(""))
            .when(port.between(0, 65535), F.concat(F.lit(":"), port.cast("string"))))


def _rebuilt(p: Column) -> Column:
    scheme = F.when(p[0] == "", F.lit("http")).otherwise(F.lower(p[0]))
    path = F.regexp_replace(p[2], r";[^/]*$", "")
    return F.concat(scheme, F.lit("://"), _host_in(p[1]),
                    _port_suffix(scheme, F.regexp_extract(p[1], r":([^:\]@]*)$", 1)),
                    F.when(path == "", F.lit("/")).otherwise(path), _query_suffix(p[3]))


def normalize_url(url: Column) -> Column:
    """Canonical form of a URL for dedup and joins (F1).

    Scheme and host are lower-cased, default ports, path parameters, fragments and tracking
    parameters dropped; other parameters keep their order and blanks.  A port that is not a
    number yields null.
    """
    return F.when(url.isNotNull(), let(_parts(url), _rebuilt))


def fold_www(host: Column) -> Column:
    """Lower-case a host and drop one leading ``www.`` (F2)."""
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def same_site(left_host: Column, right_host: Column) -> Column:
    """Same host after folding ``www.``; subdomains are other sites."""
    pair = F.struct(fold_www(left_host).alias("a"), fold_www(right_host).alias("b"))
    return let(pair, lambda x: F.coalesce((x["a"] == x["b"]) & (x["a"] != ""), F.lit(False)))


def is_http_url(url: Column) -> Column:
    """True for http and https URLs."""
    return F.coalesce(scheme_of(url).isin("http", "https"), F.lit(False))


def normalize_domain(raw: Column) -> Column:
    """Bare domain from user input: no scheme, path, query, port or ``www.``."""
    bare = F.regexp_replace(F.lower(_tidy(raw)), r"^https?://", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^[^/?#:]*", 0), r"^www\.", "")


def is_valid_domain(domain: Column) -> Column:
    return F.coalesce(domain.rlike(DOMAIN_PATTERN), F.lit(False))


def is_skipped_href(href: Column) -> Column:
    """Anchors that are no page links: empty, fragment, mail, phone, script."""
    return href.rlike(r"^\s*(?:$|#|mailto:|tel:|javascript:)")


def _without_dot_segments(path: Column) -> Column:
    folded = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    tail = F.when(path.rlike(r"(^|/)\.\.?$"), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(F.concat(folded, tail), "/")).otherwise(path)


def url_parts(url: Column) -> Column:
    """[scheme, authority, path, query] of a base URL, for ``resolve_from``."""
    return _parts(url)


def resolve_from(base: Column, href: Column) -> Column:
    """Absolute form of a link, given the parts of its page's URL.

    Handles ``//h/x``, ``/x``, ``?q``, ``x``, ``../x`` and absolute links (F19).
    """
    def joined(link: Column) -> Column:
        scheme = F.lower(base[0])
        origin = F.concat(scheme, F.lit("://"), base[1])
        base_path = F.when(base[2] == "", F.lit("/")).otherwise(base[2])
        # A rooted link replaces the base path, any other starts in its folder.
        rooted = F.when(link.startswith("/"), F.lit("")).otherwise(
            F.regexp_extract(base_path, r"^(.*/)", 1))
        path = F.concat(rooted, F.regexp_extract(link, r"^[^?#]*", 0))
        tail = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
        return (F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), link)
                .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
                .when(link.startswith("?"), F.concat(origin, base_path, link))
                .when((link == "") | link.startswith("#"), F.concat(
                    origin, base_path, F.when(base[3] == "", F.lit("")).otherwise(F.concat(F.lit("?"), base[3])), link))
                .otherwise(F.concat(origin, let(path, _without_dot_segments), tail)))

    return let(_tidy(href), joined)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    return let(_parts(base), lambda parts: resolve_from(parts, href))


def host_suffixes(host: Column) -> Column:
    """A folded host and each of its parent domains: a.b.c → [a.b.c, b.c, c]."""
    return let(F.split(fold_www(host), r"\."), lambda labels: F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


# IPv4 networks that are not globally routable.
_PRIVATE_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8),
    ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("240.0.0.0", 4),
]
# IPv6 networks that are not globally routable, and networks inside them that are.
_PRIVATE_V6 = [
    ("::", 128), ("::1", 128), ("::ffff:0:0", 96), ("64:ff9b:1::", 48), ("100::", 64), ("2001::", 23),
    ("2001:db8::", 32), ("2002::", 16), ("3fff::", 20), ("fc00::", 7), ("fe80::", 10),
]
_PUBLIC_V6 = [("2001:1::1", 128), ("2001:1::2", 128), ("2001:3::", 32), ("2001:4:112::", 48), ("2001:20::", 28), ("2001:30::", 28)]


def _number(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _reject(x: Column) -> Column:
    url, scheme, authority, host, number = (x[n] for n in ("url", "scheme", "authority", "host", "number"))
    private_v4 = F.lit(False)
    for network, bits in _PRIVATE_V4:
        low = _number(network)
        private_v4 = private_v4 | number.between(low, low + 2 ** (32 - bits) - 1)
    return (F.when(url.isNull() | (url == "") | (F.length(url) > MAX_URL_LENGTH), "length")
            .when(~scheme.isin("http", "https"), "scheme")
            .when(authority.contains("@"), "userinfo")
            .when(host == "", "no_host")
            .when(host.isin("localhost", "localhost.localdomain") | host.endswith(".localhost"),
                  "blocked_host")
            .when(F.coalesce(private_v4, F.lit(False)), "private_ip")
            .when(host.contains(":") & x["digits"].isNull(), "bad_ip")
            .when(host.contains(":") & _within(x["digits"], _PRIVATE_V6) & ~_within(x["digits"], _PUBLIC_V6), "private_ip"))


def _within(digits: Column, networks: list[tuple[str, int]]) -> Column:
    """Whether 32 hexadecimal digits lie in one of the networks; of one width, they compare as text."""
    found = F.lit(False)
    for network, bits in networks:
        low = int(IPv6Address(network))
        found = found | digits.between(f"{low:032x}", f"{low + 2 ** (128 - bits) - 1:032x}")
    return found


def _v6_digits(host: Column) -> Column:
    """An IPv6 literal in any spelling as 32 hexadecimal digits, null for what is none."""
    bare = F.regexp_replace(host, "%.*$", "")
    tail = _v4_number(F.substring_index(bare, ":", -1))
    hexed = F.when(tail.isNotNull(), F.concat(
        F.regexp_replace(bare, r"[^:]*$", ""), F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"),
        F.lower(F.hex(tail.bitwiseAND(F.lit(65535)))))).otherwise(bare)

    def padded(part: Column) -> Column:
        groups = F.filter(F.split(part, ":"), lambda g: g != "")
        return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")

    def filled(h: Column) -> Column:
        left, right = padded(F.substring_index(h, "::", 1)), padded(F.substring_index(h, "::", -1))
        gap = 32 - F.length(left) - F.length(right)
        return F.when(~h.contains("::"), padded(h)).when(gap >= 4, F.concat(left, F.repeat(F.lit("0"), gap), right))

    shaped = hexed.rlike(r"^(?:[0-9a-f]{1,4}(?::|$)|::?)+$") & ~hexed.rlike(r":::|::.*::|^:[^:]|[^:]:$")
    return let(hexed, lambda h: F.when(shaped, let(filled(h), lambda d: F.when(F.length(d) == 32, d))))


def _v4_number(host: Column) -> Column:
    """An IPv4 literal as a number, null for other hosts."""
    octets = F.transform(F.split(host, r"\."), lambda o: o.try_cast("long"))
    octet = r"(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return F.when(host.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), F.aggregate(
        octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o))


def numeric_host(host: Column) -> Column:
    """The IPv4 address that a host of one to four numbers stands for, null for other hosts.

    Numbers are decimal, octal (leading 0) or hexadecimal (leading 0x); the last one fills the bytes that are
    left, so 127.1, 0x7f.1, 0177.0.0.1 and 2130706433 are all the same address.
    """
    part = r"(?:0x[0-9a-f]*|[0-9]+)"
    bare = lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0"))

    def value(x: Column) -> Column:
        digits = F.when(x.startswith("0x"), bare(F.substr(x, F.lit(3)))).otherwise(bare(x))
        octal = x.startswith("0") & ~x.startswith("0x")
        number = F.when(x.startswith("0x"), F.conv(digits, 16, 10)).when(octal & digits.rlike("^[0-7]+$"), F.conv(digits, 8, 10)).when(~octal, digits)
        return F.when(F.length(digits) <= 12, number.try_cast("long"))

    def joined(numbers: Column) -> Column:
        n = F.size(numbers)
        fits = F.forall(F.slice(numbers, 1, n - 1), lambda v: F.coalesce(v <= 255, F.lit(False))) & (
            F.element_at(numbers, -1) < F.pow(F.lit(256.0), 5 - n).cast("long"))
        head = F.aggregate(F.slice(numbers, 1, n - 1), F.lit(0).cast("long"), lambda acc, v: acc * 256 + v)
        return F.when(fits, head * F.pow(F.lit(256.0), 5 - n).cast("long") + F.element_at(numbers, -1))

    return F.when(host.rlike(rf"^{part}(?:\.{part}){{0,3}}$"), let(F.transform(F.split(host, r"\."), value), joined))


def url_reject_reason(url: Column) -> Column:
    """Why a URL must not be crawled, null when it is safe (static part of F27)."""
    host = F.regexp_replace(host_of(url), r"\.+$", "")
    return let(F.struct(url.alias("url"), F.coalesce(scheme_of(url), F.lit("")).alias("scheme"),
                        _authority(url).alias("authority"), host.alias("host"),
                        numeric_host(host).alias("number"), _v6_digits(host).alias("digits")), _reject)

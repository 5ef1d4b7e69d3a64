"""URL functions: parts as expressions, and resolving of references by the URL standard for web schemes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WEB = ("http", "https")
_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):(.*)", re.S)
#: Characters of a host that make a URL invalid.
_NO_HOST = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
_PATH_SET, _QUERY_SET, _USER_SET = ' "#<>?^`{}', " \"#<>'", ' "#<>?^`{}/:;=@[\\]|'


def scheme(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))


def host(url: Column) -> Column:
    """The host of a URL in lower case; null if it has none or can't be parsed."""
    return F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def robots_url(url: Column) -> Column:
    """Where a site's robots.txt is: scheme and host, without a port."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit("/robots.txt"))


def shard(domain: Column, shards: int) -> Column:
    """A stable number below `shards` for a domain: the first 32 bits of its MD5, which any system can compute."""
    return F.pmod(F.conv(F.substring(F.md5(domain), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def fallback_title(url: Column) -> Column:
    """The last path segment without `.pdf`, dashes and underscores as spaces; null if that is blank."""
    last = F.regexp_extract(path(url), "([^/]*)$", 1)
    title = F.translate(F.replace(last, F.lit(".pdf"), F.lit("")), "-_", "  ")
    return F.when(F.trim(title) != "", title)


def _encode(text: str, reserved: str) -> str:
    return "".join(c if "!" <= c <= "~" and c not in reserved else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _host(text: str) -> str | None:
    if text.startswith("["):
        return text.lower() if re.fullmatch(r"\[[0-9a-fA-F:.]+\]", text) else None
    raw = re.sub(r"%([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), text) if "%" in text else text
    try:
        name = raw.lower() if raw.isascii() else raw.encode("idna").decode().lower()
    except UnicodeError:
        return None
    return None if not name or _NO_HOST.search(name) else name


def _segments(base: list[str], given: str) -> str:
    """The path that `given` leads to from the segments of a folder."""
    out, parts = list(base), given.split("/")
    for i, part in enumerate(parts):
        last, plain = i == len(parts) - 1, part.lower().replace("%2e", ".")
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_encode(part, _PATH_SET))
    return "/" + "/".join(out)


def _split(text: str) -> tuple[str, str | None, str | None]:
    text, mark, fragment = text.partition("#")
    text, question, query = text.partition("?")
    return text, query if question else None, fragment if mark else None


def _absolute(kind: str, rest: str) -> tuple | None:
    before, query, _ = _split(rest)
    authority, slash, tail = before.lstrip("/").partition("/")
    user, at, place = authority.rpartition("@")
    if at:
        name, colon, secret = user.partition(":")
        user = _encode(name, _USER_SET) + (":" + _encode(secret, _USER_SET) if colon and secret else "")
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place)
    name = found and _host(found[1])
    if not name or (found[2] and int(found[2]) > 65535):
        return None
    port = str(int(found[2])) if found[2] else ""
    netloc = (user + "@" if user else "") + name + (f":{port}" if port and port != _PORTS[kind] else "")
    return kind, netloc, _segments([], tail), query


def _parse(url: str, base: tuple | None) -> tuple | None:
    url = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    found = _SCHEME.match(url)
    if found:
        kind, rest = found[1].lower(), found[2]
        if kind not in _PORTS:
            return kind, None, rest, None
        head, mark, tail = _cut(rest)
        rest = head.replace("\\", "/") + mark + tail
        if base is None or kind != base[0] or rest.startswith("//"):
            return _absolute(kind, rest)
        return _relative(base, rest)
    if base is None or base[1] is None:
        return None
    head, mark, tail = _cut(url)
    return _relative(base, head.replace("\\", "/") + mark + tail)


def _cut(text: str) -> tuple[str, str, str]:
    """Path part and what begins with ? or #, in which backslashes stay."""
    at = min((i for i in (text.find("?"), text.find("#")) if i >= 0), default=len(text))
    return text[:at], text[at : at + 1], text[at + 1 :]


def _relative(base: tuple, ref: str) -> tuple | None:
    kind, netloc, path_, query_ = base
    if ref.startswith("//"):
        return _absolute(kind, ref)
    before, query, _ = _split(ref)
    if before.startswith("/"):
        return kind, netloc, _segments([], before[1:]), query
    if before:
        return kind, netloc, _segments(path_[1:].split("/")[:-1], before), query
    return kind, netloc, path_, query_ if query is None else query


def resolve(base: str, ref: str) -> str | None:
    """The web address, without fragment, that ref means on the page base; None for other schemes and invalid URLs."""
    origin = _parse(base, None)
    made = origin and origin[1] is not None and _parse(ref, origin)
    return text_of(made) if made and made[0] in WEB and made[1] else None


def normal(url: str) -> str | None:
    """A web address in normal form, without fragment."""
    made = _parse(url, None)
    return text_of(made) if made and made[0] in WEB and made[1] else None


def text_of(parts: tuple) -> str:
    kind, netloc, path_, query = parts
    return f"{kind}://{netloc}{path_}" + ("" if query is None else "?" + _encode(query, _QUERY_SET))

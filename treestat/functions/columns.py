"""Column functions: paths, types, permissions, presentation and source URLs. No Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- paths ---------------------------------------------------------------------------------------


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(parent, F.lit("/"), name))


def parent_of(path: Column) -> Column:
    """Parent directory; NULL for ``/``; ``/`` for top-level and for slash-less paths."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == "/", F.lit(None)).when(~path.contains("/") | (cut == ""), F.lit("/")).otherwise(cut)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """Every directory from ``/`` down to ``path`` itself, root first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    below = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("/")), below)


def top_dir(path: Column) -> Column:
    """First segment; a file directly under ``/`` is its own top directory."""
    return F.concat(F.lit("/"), F.get(F.split(path, "/"), F.lit(1)))


def is_dot(name: Column) -> Column:
    return name.isin(".", "..")


def extension(name: Column, entry_type: Column) -> Column:
    """Lower-case text after the last dot, or the whole name without one; files only, under 10 bytes, no slash."""
    tail = F.substring_index(name, ".", -1)
    return F.when((entry_type == 0) & (F.octet_length(tail) < 10) & ~tail.contains("/"), F.lower(tail))


# --- types and permissions -----------------------------------------------------------------------

#: S_IFMT bits to entry type.
MODE_TYPES = {0o100000: 0, 0o040000: 1, 0o120000: 2, 0o060000: 3, 0o020000: 4, 0o010000: 5, 0o140000: 6}
#: Protocol file-type code to entry type.
CODE_TYPES = {1: 0, 2: 1, 5: 2, 3: 3, 4: 4, 6: 6, 7: 5}


def _chosen(value: Column, table: dict[int, int]) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, F.lit(255)).cast("int")


def type_from_mode(mode: Column) -> Column:
    return _chosen(mode.bitwiseAND(0o170000), MODE_TYPES)


def type_from_code(code: Column) -> Column:
    """Entry type of a protocol code; NULL code means no attributes and gives 255."""
    return _chosen(code, CODE_TYPES)


def stored_type(value: Column) -> Column:
    return F.when(value.between(0, 6), value).otherwise(255).cast("int")


def permissions(mode: Column) -> Column:
    return mode.bitwiseAND(0o7777)


def owner_can(mode: Column, what: str) -> Column:
    return mode.bitwiseAND({"r": 0o400, "w": 0o200, "x": 0o100}[what]) != 0


def octal(mode: Column) -> Column:
    return F.conv(mode.bitwiseAND(511).cast("string"), 10, 8)


# --- sizes, times, presentation ------------------------------------------------------------------


def blocks_of(used: Column) -> Column:
    return F.call_function("div", used + 511, F.lit(512))


def allocated(blocks: Column) -> Column:
    return blocks * 512


def gb(size: Column, digits: int = 2) -> Column:
    return F.round(size.cast("double") / 1024 / 1024 / 1024, digits)


def mb(size: Column, digits: int = 2) -> Column:
    return F.round(size.cast("double") / 1024 / 1024, digits)


def _in_zone(epoch: Column, zone: str) -> Column:
    stamp = F.timestamp_seconds(epoch)
    return stamp if zone == "UTC" else F.from_utc_timestamp(stamp, zone)


def format_time(epoch: Column, zone: str = "UTC") -> Column:
    """``yyyy-MM-dd HH:mm``; NULL gives ``unknown``; what has no four-digit year is printed as the number."""
    fits = epoch.between(-62167219200, 253402300799)
    safe = F.when(fits, epoch)
    return F.when(epoch.isNull(), "unknown").when(fits, F.date_format(_in_zone(safe, zone), "yyyy-MM-dd HH:mm")).otherwise(epoch.cast("string"))


def format_time_sql(epoch: Column, zone: str = "UTC") -> Column:
    return F.date_format(_in_zone(epoch, zone), "yyyy-MM-dd HH:mm:ss")


def format_size(size: Column) -> Column:
    """Binary units with up to two decimals: ``512 B``, ``1 KiB``, ``5.13 GiB``."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1):
        x = F.round(size.cast("double") / float(1024**k), 2)
        text = F.when(size % (1024**k) == 0, F.format_string("%.0f " + unit, x)).otherwise(F.format_string("%.2f " + unit, x))
        out = F.when(size >= 1024**k, text).otherwise(out)
    return out


def format_number(n: Column) -> Column:
    return F.format_number(n, 0)


def format_elapsed(secs: Column) -> Column:
    s = secs.cast("bigint")
    whole = lambda d: F.floor(s / F.lit(d)).cast("string")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(whole(60), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(whole(3600), F.lit("h "), F.floor(s % 3600 / F.lit(60)).cast("string"), F.lit("m")))
    )


def rate(files: Column, dirs: Column, secs: Column) -> Column:
    return F.when(secs > 0, (files + dirs).cast("double") / secs.cast("double")).otherwise(F.lit(0.0))


# --- source URLs ---------------------------------------------------------------------------------

#: The URL form (server, port, path; scheme optional) and the older ``server:/export[/sub]``.
URL = r"^(?:nfs://)?([^:/]+)(?::(\d+))?(/[^\s]*)$"
OLD = r"^(?:nfs://)?((?!nfs:/).+?):(/.*)$"


def source_url_parts(url: Column, export: Column | None = None) -> Column:
    """Struct of server, port, export, subpath, full_path, walk_start_path, display and ``valid``.

    ``export`` gives the export explicitly where it has several segments; it replaces the path where the path
    is not below it. Invalid URLs give NULL parts and ``valid`` false.
    """
    url = F.trim(url)
    new, old = url.rlike(URL), url.rlike(OLD) & ~url.rlike(URL)
    none = F.lit(None).cast("string")
    server = F.when(new, F.regexp_extract(url, URL, 1)).when(old, F.regexp_extract(url, OLD, 1)).otherwise(none)
    port = F.when(new, F.nullif(F.regexp_extract(url, URL, 2), F.lit(""))).cast("int")
    raw = F.when(new, F.regexp_extract(url, URL, 3)).when(old, F.regexp_extract(url, OLD, 2)).otherwise(none)
    path = F.regexp_replace(raw, "/+$", "")
    first = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "^(/[^/]+)", 1))
    share = first if export is None else F.when(export.isNull(), first).otherwise(F.coalesce(F.nullif(F.regexp_replace(export, "/+$", ""), F.lit("")), F.lit("/")))
    if export is not None:
        share = F.when(share.startswith("/"), share).otherwise(F.concat(F.lit("/"), share))
    below = (share == "/") | (path == share) | path.startswith(F.concat(share, F.lit("/")))
    valid = F.coalesce(server.isNotNull() & (share != ""), F.lit(False))
    sub = F.when(share == "/", path).when(below & (F.length(path) > F.length(share)), F.substr(path, F.length(share) + 1)).otherwise(F.lit(""))
    full = F.when(sub == "", share).when(share == "/", sub).otherwise(F.concat(share, sub))
    keep = lambda x: F.when(valid, x)
    return F.struct(
        keep(server).alias("server"),
        keep(port).alias("port"),
        keep(share).alias("export"),
        keep(sub).alias("subpath"),
        keep(full).alias("full_path"),
        keep(F.when(sub == "", F.lit("/")).otherwise(sub)).alias("walk_start_path"),
        keep(F.concat(F.lit("nfs://"), server, F.when(port.isNotNull(), F.concat(F.lit(":"), port.cast("string"))).otherwise(F.lit("")), full)).alias("display"),
        valid.alias("valid"),
    )

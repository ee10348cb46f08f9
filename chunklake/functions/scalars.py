"""Scalar functions as Column expressions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def git_blob_hash(content: Column) -> Column:
    """SHA-1 of the git blob with these bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def to_hex(content: Column) -> Column:
    return F.lower(F.hex(content))


def from_hex(text: Column) -> Column:
    """Bytes of an even number of hex digits in lower case; null otherwise."""
    return F.when(text.rlike("^([0-9a-f]{2})*$"), F.unhex(text))


def le_integer(content: Column) -> Column:
    """The integer of up to eight bytes, least first."""
    return F.conv(F.concat(*[F.substring(F.hex(content), 2 * i + 1, 2) for i in reversed(range(8))]), 16, 10).cast("bigint")


def day_to_date(day: Column) -> Column:
    """YYYY-MM-DD of a day number."""
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")


def date_to_day(text: Column) -> Column:
    """The day number of a strict YYYY-MM-DD; null for anything else, also for days that don't exist."""
    d = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(d, "yyyy-MM-dd") == text, F.unix_date(d))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def human_bytes(n: Column) -> Column:
    """Powers of 1024, one decimal below 10 from KiB on."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for i, u in enumerate(units[1:], 1):
        v = n / float(1024**i)
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", v), F.lit(f" {u}"))).otherwise(out)
    return out


def human_count(n: Column) -> Column:
    """K, M, B and T with one decimal."""
    out = n.cast("bigint").cast("string")
    for i, u in enumerate("KMBT", 1):
        out = F.when(n >= 1000**i, F.concat(F.format_string("%.1f", n / float(1000**i)), F.lit(u))).otherwise(out)
    return out


def short_hash(c: Column, n: int = 12) -> Column:
    return F.substring(c, 1, n)


def ago(seconds: Column) -> Column:
    """The largest whole unit of a span: 3 days ago."""
    out = F.lit("just now")
    for size, unit in ((60, "minute"), (3600, "hour"), (86400, "day"), (30 * 86400, "month"), (365 * 86400, "year")):
        n = F.floor(seconds / size)
        out = F.when(seconds >= size, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))).otherwise(out)
    return out


def uptime_percent(answered: Column, probes: Column) -> Column:
    return F.when(probes > 0, F.concat(F.format_string("%.1f", answered * 100.0 / probes), F.lit("%"))).otherwise("-")


def megabytes(n: Column) -> Column:
    return F.round(n / 1e6, 1)


def percent(part: Column, whole: Column) -> Column:
    """One decimal; 0.0 of a zero whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / F.nullif(whole, F.lit(0)), 1))


def url_encode(c: Column) -> Column:
    """Everything but unreserved characters percent-encoded; a blank becomes %20."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode(c: Column) -> Column:
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def next_link(header: Column) -> Column:
    """The target of rel="next" in a Link header."""
    return F.nullif(F.regexp_extract(header, r'<([^>]*)>\s*;\s*rel="?next"?', 1), F.lit(""))


HOST, NAMESPACE = "registry.ollama.ai", "library"  # fixed values: what a name stands for that leaves them out


def model_name(c: Column, host: str = HOST, namespace: str = NAMESPACE) -> Column:
    """struct(host, namespace, model, tag) of [scheme://][host/][namespace/]model[:tag], blanks around it not counting; null when it is none, also
    for a name with a digest."""
    part = "[A-Za-z0-9._-]{1,128}"
    form = rf"^(?:(?:([A-Za-z0-9._:-]{{1,128}})/)?({part})/)?({part})(?::({part}))?$"
    s = F.regexp_replace(F.trim(c), "^(https?://)+", "")
    g = lambda i, d: F.coalesce(F.nullif(F.regexp_extract(s, form, i), F.lit("")), F.lit(d))
    n = F.struct(g(1, host).alias("host"), g(2, namespace).alias("namespace"), g(3, "").alias("model"), g(4, "latest").alias("tag"))
    dots = F.exists(F.array(*[n[x] for x in ("host", "namespace", "model", "tag")]), lambda p: p.isin(".", ".."))
    return F.when(s.rlike(form) & ~dots, n)


def model_display(n: Column) -> Column:
    """A parsed name as people write it: without the parts that are understood, but with its tag."""
    space = F.when(n["namespace"] == NAMESPACE, n["model"]).otherwise(F.concat_ws("/", n["namespace"], n["model"]))
    return F.concat(F.when(n["host"] == HOST, space).otherwise(F.concat_ws("/", n["host"], n["namespace"], n["model"])), F.lit(":"), n["tag"])


def model_path(n: Column) -> Column:
    """Where a tag's manifest is kept below a folder of models."""
    return F.when(n.isNotNull(), F.concat_ws("/", F.lit("manifests"), n["host"], n["namespace"], n["model"], n["tag"]))


def digest(c: Column) -> Column:
    """The hex of sha256:<64 hex digits>; null otherwise."""
    return F.nullif(F.regexp_extract(c, "^sha256[:-]([0-9a-f]{64})$", 1), F.lit(""))


def layer_path(media_type: Column, hex_: Column) -> Column:
    """Where a layer's bytes go; model, projector, adapter and draft layers are GGUF files."""
    return F.concat(F.lit("sha256-"), hex_, F.when(media_type.rlike(r"image\.(model|projector|adapter|draft)$"), ".gguf").otherwise(""))


def gguf_set(path: Column) -> Column:
    """struct(stem, total) of a shard's path; a file on its own is a set of one."""
    form = r"^(.*)-[0-9]{5}-of-([0-9]{5})\.gguf$"
    m = path.rlike(form)
    return F.struct(
        F.when(m, F.regexp_extract(path, form, 1)).otherwise(path).alias("stem"),
        F.when(m, F.regexp_extract(path, form, 2).cast("int")).otherwise(1).alias("total"),
    )


def layer_key(name: Column) -> Column:
    """struct(group, number, name) by which tensors are fetched: embeddings (0), numbered layers (1), the rest (2)."""
    n = F.try_element_at(F.filter(F.split(name, r"\."), lambda p: p.rlike("^[0-9]{1,18}$")), F.lit(1)).cast("bigint")
    early = name.rlike("(embed|wte|wpe)")
    group = F.when(n.isNotNull(), 1).when(early, 0).otherwise(2)
    return F.struct(group.alias("group"), F.coalesce(n, F.lit(0)).alias("number"), name.alias("name"))


def challenge(header: Column) -> Column:
    """The k="v" pairs of a WWW-Authenticate header as a map."""
    return F.map_from_entries(
        F.transform(
            F.regexp_extract_all(header, F.lit(r'([A-Za-z_]+)="[^"]*"'), F.lit(0)),
            lambda p: F.struct(F.regexp_extract(p, "^([A-Za-z_]+)=", 1), F.regexp_extract(p, '"(.*)"$', 1)),
        )
    )


def progress_bytes(n: Column) -> Column:
    """Powers of 1000 with one decimal: KB, MB, GB."""
    return (
        F.when(n >= 10**9, F.concat(F.format_string("%.1f", n / 1e9), F.lit(" GB")))
        .when(n >= 10**6, F.concat(F.format_string("%.1f", n / 1e6), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1e3), F.lit(" KB")))
    )


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(F.least(done, total) * 100 / total).cast("int")).otherwise(100)


def eta(left: Column, speed: Column) -> Column:
    """m:ss until `left` bytes have come at `speed`, rounded up; null without speed."""
    s = F.ceil(left / speed).cast("bigint")
    return F.when(speed > 0, F.format_string("%d:%02d", F.floor(s / 60).cast("bigint"), s % 60))


def metric_line(name: Column, help_: Column, kind: Column, value: Column) -> Column:
    return F.concat(F.lit("# HELP "), name, F.lit(" "), help_, F.lit("\n# TYPE "), name, F.lit(" "), kind, F.lit("\n"), name, F.lit(" "), value.cast("string"))


def network(ip: Column) -> Column:
    """The network a client counts as: /24 of IPv4 (also when mapped into IPv6), /48 of IPv6; null when it is no address."""
    v4 = F.regexp_extract(ip, r"^(?:::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", 1)
    parts = F.split(F.lower(ip), "::")
    head = F.filter(F.split(parts[0], ":"), lambda p: p != "")
    tail = F.filter(F.split(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), ":"), lambda p: p != "")
    fill = F.when(F.size(parts) > 1, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(tail), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    full = F.transform(F.concat(head, fill, tail), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    v6 = ip.rlike("^[0-9A-Fa-f:]+$") & ip.contains(":") & (F.size(full) == 8)
    return F.when(v4 != "", F.concat(v4, F.lit(".0/24"))).when(v6, F.concat(F.array_join(F.slice(full, 1, 3), ":"), F.lit("::/48")))


def exponent_of(x: Column) -> Column:
    """The biased exponent of a float's single-precision value, by arithmetic on its size."""
    a = F.abs(x.cast("double"))
    e = F.floor(F.log2(a)).cast("int")
    e = F.when(a >= F.pow(F.lit(2.0), e + 1), e + 1).when(a < F.pow(F.lit(2.0), e), e - 1).otherwise(e)
    return F.when(a == 0, 0).when(e < -126, 0).otherwise(e + 127)

"""Predicates of the registry, the store and the board as Column expressions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of formats that can run code when loaded.
UNSAFE = ("bin", "pt", "pth", "ckpt", "pkl", "pickle", "joblib", "dill", "pd", "npy", "npz", "h5", "hdf5", "keras")
SKEW = 600
ACTIVE_DAYS = 7
DAY = 86400
MAX_CHUNK = 256 * 1024
MANIFEST_FORMATS = ("manifest/v1", "manifest/v2")


def extension(path: Column) -> Column:
    """The last extension of the last part of a path in lower case; null without a dot."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1)))


def is_unsafe(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*UNSAFE), F.lit(False))


def first_unsafe(files: Column) -> Column:
    """The first unsafe path among a manifest's files (structs with a path), else null: such a manifest is refused."""
    return F.try_element_at(F.transform(F.filter(files, lambda f: is_unsafe(f["path"])), lambda f: f["path"]), F.lit(1))


def is_hash(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_meta_key(c: Column) -> Column:
    """Parts of letters, digits, dot, underscore, percent and hyphen, joined by slashes, none of them . or .."""
    return F.coalesce(c.rlike("^[A-Za-z0-9._%-]+(/[A-Za-z0-9._%-]+)*$") & ~c.rlike(r"(^|/)\.{1,2}(/|$)"), F.lit(False))


def is_part(c: Column, most: int) -> Column:
    return F.coalesce((F.length(c) <= most) & c.rlike("^[A-Za-z0-9_-][A-Za-z0-9._-]*$"), F.lit(False))


def is_name(c: Column) -> Column:
    """org/model, parted at the first slash."""
    at = F.instr(c, "/")
    return F.coalesce((at > 0) & is_part(c.substr(F.lit(1), at - 1), 64) & is_part(c.substr(at + 1, F.length(c)), 96), F.lit(False))


def is_rev(c: Column) -> Column:
    return is_part(c, 64)


def is_repo(c: Column) -> Column:
    at = F.instr(c, "/")
    return F.coalesce((at > 0) & is_part(c.substr(F.lit(1), at - 1), 96) & is_part(c.substr(at + 1, F.length(c)), 96), F.lit(False))


def parse_ref(c: Column) -> Column:
    """struct(name, rev) of name[@rev]; the revision is main unless given; null when either isn't valid."""
    name, rev = F.substring_index(c, "@", 1), F.when(F.instr(c, "@") > 0, c.substr(F.instr(c, "@") + 1, F.length(c))).otherwise("main")
    return F.when(is_name(name) & is_rev(rev), F.struct(name.alias("name"), rev.alias("rev")))


def is_display_name(c: Column) -> Column:
    """1 to 40 characters without blanks around them or control characters in them."""
    return F.coalesce(F.char_length(c).between(1, 40) & (F.trim(c) == c) & ~c.rlike(r"\p{Cntrl}"), F.lit(False))


def is_unsafe_path(c: Column) -> Column:
    """A path that could leave its folder."""
    return F.coalesce(F.exists(F.split(c, "/"), lambda p: (p == "..") | (p == "")), F.lit(True))


def is_commit(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{40}$"), F.lit(False))


def within_skew(a: Column, b: Column, most: int = SKEW) -> Column:
    return F.abs(a - b) <= most


def may_operate(key: Column, operator: Column, delegate: Column, expires: Column, at: Column) -> Column:
    """Whether a key acts for the operator at a time: the operator's own, or a delegate's that hasn't expired."""
    return F.coalesce((key == operator) | ((key == delegate) & (at < expires)), F.lit(False))


def ticket_valid(issuer: Column, issuers: Column, holder: Column, peer: Column, expires: Column, at: Column, sig_ok: Column) -> Column:
    return F.coalesce(F.array_contains(issuers, issuer) & (holder == peer) & (at < expires) & sig_ok, F.lit(False))


def blob_known(version: Column, codec: Column) -> Column:
    return F.coalesce(version.isin(1, 2) & codec.between(0, 5) & ((version >= 2) | (codec <= 3)), F.lit(False))


def manifest_known(fmt: Column) -> Column:
    return F.coalesce(fmt.isin(*MANIFEST_FORMATS), F.lit(False))


def is_active(last_seen: Column, at: Column) -> Column:
    return at - last_seen < ACTIVE_DAYS * DAY


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, end), half open, of `bytes=a-b`, `bytes=a-` or `bytes=-n` within a body of `size` bytes; null when there is none."""
    a = F.try_to_number(F.regexp_extract(header, r"^bytes=(\d+)-\d*$", 1), F.lit("999999999999999999")).cast("bigint")
    b = F.try_to_number(F.regexp_extract(header, r"^bytes=\d+-(\d+)$", 1), F.lit("999999999999999999")).cast("bigint")
    n = F.try_to_number(F.regexp_extract(header, r"^bytes=-(\d+)$", 1), F.lit("999999999999999999")).cast("bigint")
    start = F.when(n.isNotNull(), F.greatest(size - n, F.lit(0))).otherwise(a)
    end = F.when(n.isNotNull() | b.isNull(), size).otherwise(F.least(b + 1, size))
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end")))


def manifest_sound(size: Column, lengths: Column) -> Column:
    """Every chunk within the limit and all of them together as long as the file."""
    return F.forall(lengths, lambda n: n <= MAX_CHUNK) & (F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, n: s + n) == size)


def trusted(signatures: Column, keys: Column) -> Column:
    """Any valid signature (key, ok) by a trusted key."""
    return F.coalesce(F.exists(signatures, lambda s: F.array_contains(keys, s["key"]) & s["ok"]), F.lit(False))


def record_usable(size: Column, upstream_size: Column, etag: Column, upstream_etag: Column) -> Column:
    """A cached record still holds: size unknown upstream or equal, and etags equal unless upstream's is no content hash."""
    content = upstream_etag.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")
    return (upstream_size.isNull() | (size == upstream_size)) & (~F.coalesce(content, F.lit(False)) | F.coalesce(etag == upstream_etag, F.lit(False)))


def entry_answers(kind: Column, name: Column, rev: Column, root: Column, asked_name: Column, asked_rev: Column, sig_ok: Column) -> Column:
    """Whether a log entry answers a lookup: a publish of the same name and revision, with a valid root and signature."""
    return F.coalesce((kind == "publish") & (name == asked_name) & (rev == asked_rev) & is_hash(root) & sig_ok, F.lit(False))

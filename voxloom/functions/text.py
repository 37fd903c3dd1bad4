"""Scalar functions on texts, paths, times, sizes and keys, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_white(x: str | Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(x), rf"^{WHITE}+|{WHITE}+$", "")


def blank(x: str | Column) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(trim_white(x) == "", F.lit(True))


def estimate_tokens(x: str | Column) -> Column:
    """Han characters and wide signs count one each, four of all other characters one, rounded up."""
    wide = F.regexp_count(_col(x), F.lit(r"[\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]")).cast("long")
    return wide + F.ceil((F.length(_col(x)) - wide) / 4).cast("long")


def slugify(x: str | Column, longest: int = 80, default: str = "untitled") -> Column:
    """A name safe for a folder: illegal and control characters become blanks, blanks are folded, final dots dropped, then cut."""
    out = F.regexp_replace(F.coalesce(_col(x), F.lit("")), r'[<>:"/\\|?*\x00-\x1f\x7f-\x9f]', " ")
    out = F.regexp_replace(trim_white(F.regexp_replace(out, rf"{WHITE}+", " ")), r"\.+$", "")
    out = trim_white(F.left(out, F.lit(longest)))
    return F.when(out == "", F.lit(default)).otherwise(out)


def basename(x: str | Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(_col(x), "/"), -1)


def parent(x: str | Column) -> Column:
    """What precedes the last slash, empty at the root."""
    return F.regexp_replace(_col(x), r"/?[^/]*$", "")


def depth(x: str | Column) -> Column:
    """Number of parts of a path, 0 for the root."""
    return F.when(_col(x) == "", F.lit(0)).otherwise(F.size(F.split(_col(x), "/")))


def shard(x: str | Column) -> Column:
    """The folder of a key: its first two characters."""
    return F.left(_col(x), F.lit(2))


def encode_path(x: str | Column) -> Column:
    """Percent-encoded UTF-8, but for letters, digits and - . _ ~ /."""
    out = F.url_encode(_col(x))
    for a, b in ((r"\+", "%20"), ("%2F", "/"), (r"\*", "%2A"), ("%7E", "~")):
        out = F.regexp_replace(out, a, b)
    return out


def decode_path(x: str | Column) -> Column:
    """Percent escapes resolved; a plus stays a plus, and what is no escape stays as it is."""
    safe = F.regexp_replace(F.regexp_replace(_col(x), r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.url_decode(safe)


def href_path(x: str | Column, root: str = "") -> Column:
    """The path below root that a DAV href names, decoded and without slashes around it; null outside root."""
    path = F.regexp_replace(_col(x), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    path = F.regexp_replace(decode_path(path), r"^/+|/+$", "")
    root = root.strip("/")
    if not root:
        return path
    return F.when(path == root, F.lit("")).when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30))


def is_audio_path(x: str | Column) -> Column:
    """Whether the file's extension, in any case, is one of recordings; a leading dot begins no extension."""
    # Fixed values.
    kinds = ["wav", "mp3", "m4a", "aac", "flac", "ogg", "opus", "wma"]
    return F.lower(F.regexp_extract(_col(x), r"[^/]\.([^./]+)$", 1)).isin(*kinds)


def glob_regex(pattern: str) -> str:
    """The regular expression of a pattern in which * stands for any characters and ? for one, slashes included."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


def glob_match(x: str | Column, pattern: str) -> Column:
    """Whether a text matches a pattern as a whole, case-sensitively."""
    return _col(x).rlike(glob_regex(pattern))


def under(x: str | Column, folders: list[str]) -> Column:
    """Whether a path is one of folders or lies below one."""
    out = F.lit(False)
    for f in folders:
        f = f.rstrip("/")
        out = out | (_col(x) == f) | _col(x).startswith(f + "/")
    return out


def selected(x: str | Column, include: list[str], exclude: list[str], folders_out: list[str], audio: bool) -> Column:
    """Whether a path is selected: excluded folders first, then recordings, then patterns; an empty include takes all."""
    any_of = lambda patterns: F.coalesce(*[F.when(glob_match(x, p), F.lit(True)) for p in patterns], F.lit(False)) if patterns else F.lit(False)
    out = ~under(x, folders_out) & ~any_of(exclude)
    if not audio:
        out = out & ~is_audio_path(x)
    return out & any_of(include) if include else out


def format_time(ms: str | Column) -> Column:
    """HH:MM:SS; hours may have more than two digits."""
    s = F.floor(_col(ms) / 1000)
    return F.when(s.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def format_time_short(ms: str | Column) -> Column:
    """MM:SS under one hour, else HH:MM:SS."""
    s = F.floor(_col(ms) / 1000)
    return F.when(s >= 3600, format_time(ms)).when(s.isNotNull(), F.format_string("%02d:%02d", F.floor(s % 3600 / 60), s % 60))


def format_srt(ms: str | Column) -> Column:
    """HH:MM:SS,mmm."""
    x = _col(ms)
    return F.concat(format_time(ms), F.lit(","), F.lpad((x % 1000).cast("string"), 3, "0"))


def human_size(n: str | Column) -> Column:
    """Bytes in B, KB, MB or GB of 1024, with one decimal from KB on."""
    x = _col(n).cast("double")
    out = F.when(x < 1024, F.concat(_col(n).cast("string"), F.lit(" B")))
    for unit, power in (("KB", 1), ("MB", 2), ("GB", 3)):
        value = F.format_string("%.1f " + unit, x / float(1024**power))
        out = out.when(x < 1024.0 ** (power + 1), value) if power < 3 else out.otherwise(value)
    return out


def content_key(*parts: str | Column) -> Column:
    """SHA-256, in hexadecimal, of the parts joined by |; a null part is an empty one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]), 256)


def parse_size(x: str | Column) -> Column:
    """A whole number without sign, blanks around it allowed; null for all else."""
    return F.when(trim_white(x).rlike(r"^\d+$"), F.try_to_number(trim_white(x), F.lit("9" * 19)).cast("long"))


def numbered_lines(x: str | Column) -> Column:
    """The texts of lines like '1. text', as an array; a line without a number counts only if it comes first."""
    lines = F.filter(F.transform(F.split(_col(x), r"\r?\n"), trim_white), lambda v: v != "")
    rest = lambda v: F.regexp_replace(v, r"^\d+\s*(?:[.、)）:：]\s*)?", "")
    return F.transform(F.filter(lines, lambda v, i: v.rlike(r"^\d") | (i == 0)), lambda v: F.when(v.rlike(r"^\d"), rest(v)).otherwise(v))


def correction_accepted(old: str | Column, new: str | Column, low: float = 0.34, high: float = 3.0) -> Column:
    """Whether a correction may replace a text: not blank, not equal, and of a length within low and high times the old."""
    ratio = (F.length(_col(new)) / F.greatest(F.length(_col(old)), F.lit(1))).cast("float")
    return F.coalesce(~blank(new) & (_col(new) != _col(old)) & ratio.between(F.lit(low).cast("float"), F.lit(high).cast("float")), F.lit(False))


def dated(x: str | Column) -> Column:
    """The date YYYY-MM-DD before the first underscore of a folder's name; null without one."""
    return F.nullif(F.regexp_extract(_col(x), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})_", 1), F.lit(""))


def title_of(x: str | Column) -> Column:
    """A title from a folder's name: without date and the number _2 to _99 of equal names; the name if nothing remains."""
    rest = F.regexp_replace(_col(x), r"^(?=[^_]{10}_)[^_-]*-[^_-]*-[^_-]*_", "")
    rest = F.regexp_replace(rest, r"(?s)^(.+)_[0-9]{0,2}$", "$1")
    return F.when(trim_white(rest) == "", _col(x)).otherwise(rest)


def is_placeholder(x: str | Column) -> Column:
    """Whether a title says nothing: blank, digits only, or one of a few words, alone or before a blank, ( _ or -."""
    words = "recording|audio|input|output|untitled"  # fixed values
    return blank(x) | trim_white(x).rlike(rf"(?i)^(?:[0-9]+|(?:{words})(?:[ (_-].*)?)$")


def shortened(x: str | Column, longest: int) -> Column:
    """The text, or its beginning with … if it has more than longest characters."""
    return F.when(F.length(_col(x)) <= longest, _col(x)).otherwise(F.concat(F.left(_col(x), F.lit(max(longest - 1, 0))), F.lit("…")))


def short_id(x: str | Column) -> Column:
    """The first eight characters."""
    return F.left(_col(x), F.lit(8))


def masked(x: str | Column) -> Column:
    """A secret with its middle hidden; up to eight characters are hidden altogether."""
    n = F.length(_col(x))
    return F.when(n <= 8, F.repeat(F.lit("*"), F.greatest(n, F.lit(1)))).otherwise(F.concat(F.left(_col(x), F.lit(4)), F.lit("****"), F.right(_col(x), F.lit(4))))


def progress_share(x: str | Column) -> Column:
    """The share, within 0 and 1, that a line with the word progress states before its last %; null without one."""
    digits = F.regexp_extract(_col(x), r"([0-9]+)%[^%]*$", 1)
    return F.when(_col(x).contains("progress") & (digits != ""), F.least(F.try_to_number(F.right(digits, F.lit(9)), F.lit("9" * 9)) / 100, F.lit(1.0)).cast("double"))


def slice_total(x: str | Column) -> Column:
    """The number after the first 'processing ' of a line; null without one."""
    return F.nullif(F.regexp_extract(_col(x), r"(?s)^(?:(?!processing ).)*processing ([0-9]{1,18})", 1), F.lit("")).cast("long")


def format_length(ms: str | Column) -> Column:
    """H:MM:SS, or M:SS under one hour."""
    s = F.floor(_col(ms) / 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).when(s.isNotNull(), F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def spoken_length(ms: str | Column) -> Column:
    """A length of time in words: seconds under a minute, minutes under an hour, else hours and minutes."""
    s = F.floor(_col(ms) / 1000)
    hours, minutes = F.format_string("about %d h", F.floor(s / 3600)), F.format_string(" %d min", F.floor(s % 3600 / 60))
    return F.when(s < 60, F.format_string("about %d s", s)).when(s < 3600, F.format_string("about %d min", F.floor(s / 60))).when(s.isNotNull(), F.concat(hours, F.when(s % 3600 < 60, "").otherwise(minutes)))


def format_day(ms: str | Column) -> Column:
    """YYYY-MM-DD of Unix milliseconds, in UTC."""
    return F.date_format(F.date_from_unix_date(F.floor(_col(ms) / 86_400_000).cast("int")), "yyyy-MM-dd")


def format_minute(ms: str | Column) -> Column:
    """YYYY-MM-DD HH:MM of Unix milliseconds, in UTC; times before 1970 count as its beginning."""
    x = F.greatest(_col(ms), F.lit(0))
    x = F.when(_col(ms).isNotNull(), x)
    return F.concat(format_day(x), F.format_string(" %02d:%02d", F.floor(x / 3_600_000) % 24, F.floor(x / 60_000) % 60))


def joined_path(*parts: str | Column) -> Column:
    """Parts of a path joined by single slashes, blank ones left out."""
    pieces = F.flatten(F.array(*[F.split(F.coalesce(_col(p), F.lit("")), "/") for p in parts]))
    return F.array_join(F.filter(pieces, lambda p: trim_white(p) != ""), "/")


def safe_path(x: str | Column) -> Column:
    """The path if it is relative and never leaves its root; null if it is empty, absolute or has a part '..'."""
    text = F.replace(_col(x), F.lit("\\"), F.lit("/"))
    bad = blank(x) | text.startswith("/") | text.rlike("^[A-Za-z]:") | F.array_contains(F.split(text, "/"), "..")
    return F.when(~bad, text)


def split_service_url(x: str | Column, roots: list[str]) -> Column:
    """(base, folder) of the address of a folder in a store: cut behind the last of the known roots, else before the last of two or more parts; null if there is nothing to cut."""
    url = F.regexp_replace(trim_white(x), "/+$", "")
    host, path = F.regexp_extract(url, r"^(https?://[^/]+)", 1), F.regexp_extract(url, r"^https?://[^/]+(/.*)$", 1)
    known = F.regexp_extract(path, "(?s)^(.*(?:" + "|".join(re.escape(r) for r in roots) + "))", 1) if roots else F.lit("")
    parts = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    cut = F.when(known != "", known).when(parts >= 2, F.regexp_replace(path, "[^/]+$", ""))
    folder = trim_white(F.regexp_replace(F.substring(path, F.length(cut) + 1, F.length(path)), "^/+|/+$", ""))
    return F.when((host != "") & cut.isNotNull() & (folder != ""), F.struct(F.concat(host, F.regexp_replace(cut, "/+$", "")).alias("base"), folder.alias("folder")))


def prompt_of(words: str | Column, hint: str, longest: int = 200, between: str = ", ") -> Column:
    """A recogniser's prompt: the hint and an array of words, cut at longest characters."""
    return F.left(F.concat_ws(". ", F.lit(hint), F.nullif(F.array_join(_col(words), between), F.lit(""))), F.lit(longest))


def words_version(words: str | Column) -> Column:
    """A number for an array of words: the first four bytes, the lowest first, of SHA-256 over the words, each with a line end; 0 for none."""
    text = F.concat(F.array_join(_col(words), "\n"), F.lit("\n"))
    h = F.left(F.sha2(F.encode(text, "UTF-8"), 256), F.lit(8))
    turned = F.concat(*[F.substring(h, n, 2) for n in (7, 5, 3, 1)])
    return F.when(F.size(_col(words)) > 0, F.conv(turned, 16, 10).cast("long")).otherwise(F.lit(0))


def _four_bytes(x: Column) -> Column:
    """A number as four bytes, the lowest first."""
    h = F.lpad(F.hex(x), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, n, 2) for n in (7, 5, 3, 1)]))


def transcript_key(
    content: str | Column, model: str | Column, backend: str | Column, language: str | Column, diarized: str | Column, diarizer: str | Column,
    speakers: str | Column, vad: str | Column, words: str | Column, chunk: str | Column,
) -> Column:
    """The key of a cached transcript: SHA-256 over its ten parts.

    Absent: language 'auto', diarizer '-', speakers (a fixed number) 'auto', chunk the
    largest number. Flags are a byte, words (a version) and chunk four bytes, the
    lowest first; parts are joined by |.
    """
    text = lambda x, default="": F.encode(F.coalesce(_col(x).cast("string"), F.lit(default)), "UTF-8")
    flag = lambda x: F.when(F.coalesce(_col(x), F.lit(False)), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    tag = F.encode(F.coalesce(F.concat(F.lit("fixed"), _col(speakers).cast("string")), F.lit("auto")), "UTF-8")
    numbers = [_four_bytes(F.coalesce(_col(x).cast("long"), F.lit(default))) for x, default in ((words, 0), (chunk, 0xFFFFFFFF))]
    parts = [text(content), text(model), text(backend), text(language, "auto"), flag(diarized), text(diarizer, "-"), tag, flag(vad), *numbers]
    bar = F.encode(F.lit("|"), "UTF-8")
    return F.sha2(F.concat(*[p for part in parts for p in (bar, part)][1:]), 256)


def diarize_key(content: str | Column, segmenter: str | Column, embedder: str | Column, backend: str | Column) -> Column:
    """The key of cached speaker intervals: SHA-256 over content and models; the number of speakers is no part of it."""
    return F.sha2(F.concat_ws("|", _col(content), F.lit("diarize"), _col(segmenter), _col(embedder), _col(backend)), 256)


def sample_key(profile: str | Column, session: str | Column, start: str | Column) -> Column:
    """The key of a voice sample."""
    return F.concat_ws("-", _col(profile), _col(session), _col(start).cast("string"))


def scene_sample(x: str | Column, take: int = 700) -> Column:
    """The text, or of one of more than three times take characters its beginning, middle and end, under headings."""
    n = F.length(_col(x))
    middle = F.substring(_col(x), F.floor(n / 2).cast("int") - take // 2 + 1, F.lit(take))
    cut = F.concat(F.lit("[start]\n"), F.left(_col(x), F.lit(take)), F.lit("\n\n[middle]\n"), middle, F.lit("\n\n[end]\n"), F.right(_col(x), F.lit(take)))
    return F.when(n <= 3 * take, _col(x)).otherwise(cut)


# Words that tell a lecture or a meeting.
LECTURE_WORDS = ("这节课", "作业", "考试", "同学", "公式", "例题")
MEETING_WORDS = ("议题", "决议", "待办", "下周", "负责", "进度")


def guessed_scene(x: str | Column, lecture: tuple[str, ...] = LECTURE_WORDS, meeting: tuple[str, ...] = MEETING_WORDS) -> Column:
    """(scene, confidence) by how many different words of each kind a text holds; a lecture if equally many, other with 0.3 if none."""
    count = lambda words: sum((F.when(F.contains(_col(x), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    a, b = count(lecture), count(meeting)
    sure = lambda n: F.round(0.7 + 0.05 * n, 2)
    scene = F.when((a == 0) & (b == 0), "other").when(a >= b, "lecture").otherwise("meeting")
    return F.struct(scene.alias("scene"), F.when(scene == "other", 0.3).otherwise(sure(F.greatest(a, b))).alias("confidence"))

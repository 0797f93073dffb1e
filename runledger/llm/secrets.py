"""Secret scans: fixed forms, and strings in sensitive places that a primed compressor finds new."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import columns

#: Fixed forms.  Keywords in either case, ASCII only; a value that is too short drops the match.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Words of sensitive meaning, and words that are written together with them.
WORDS = ("key|oauth|auth|authorization|bearer|credential|private|access|pwd|passwd|password|passphrase|passcode|"
         "secret|token|signature|session|jwt")
BESIDE = "api|id|client|public|user|app|db|aws|ssh|my|refresh"


def _sensitive() -> re.Pattern:
    """The words as parts of identifiers: cut at what is no letter and in camel case; plurals and words run together count."""
    def part(case, before, after):
        words, beside = ("|".join(map(case, x.split("|"))) for x in (WORDS, BESIDE))
        return f"{before}(?:{beside})*(?:{words})(?:{words}|{beside})*{case('s')}?{after}"

    lower = part(str, "(?:(?<![A-Za-z])|(?<=[A-Z][A-Z]))", "(?![a-z])")
    upper = part(str.upper, "(?<![A-Z])", "(?:(?![A-Za-z])|(?=[A-Z][a-z]))")
    title = f"(?:{'|'.join(map(str.title, WORDS.split('|')))})(?:{WORDS}|{BESIDE})*s?(?![a-z])"
    return re.compile(f"{lower}|{upper}|{title}")


SENSITIVE = _sensitive()
SENSITIVE_WORDS = tuple(w.encode() for w in ("key", "auth", "bearer", "credential", "private", "access", "pwd", "pass", "secret", "token",
                                             "signature", "session", "jwt"))
#: A candidate of the method: a long word of key-like characters on the line of a sensitive word, or so near to one.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
INNER_EQUALS = re.compile(r"=+(?=[^=])")
LEAST = 16
NEAR = 200
#: A private key in PEM, and its body: lines of base64, also quoted or with escaped line ends.
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile("-----END")
PEM_LINE = re.compile(r"(?<!\\)[A-Za-z0-9+/]{16,}")
_SEP = r"""(?:\s|\\[nrt]|["',>|]|\+(?=\s))"""
PEM_BODY = re.compile(rf"{_SEP}*([A-Za-z0-9+/]{{16,}}={{0,2}}(?:{_SEP}+[A-Za-z0-9+/]{{16,}}={{0,2}})*"
                      rf"(?:{_SEP}+(?:[A-Za-z0-9+/]{{1,15}}={{0,2}}(?={_SEP}*(?:=|-----END))|[A-Za-z0-9+/]{{1,14}}={{1,2}}))?)")
#: What code and settings are full of; a candidate made of it is not new.
IDENTIFIERS = (
    "configuration environment_variable authentication authorization access_key secret_key private_key public_key "
    "api_key session_token bearer_token refresh_token client_id client_secret connection_string database_password "
    "username user_name password_hash credentials certificate signature identifier application default_value "
    "get_default_instance initialize_application content_type application/json x-www-form-urlencoded max_connections "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 example placeholder changeme undefined null none"
)
CONTEXT = 200
#: Marginal compressed bytes per character from which a candidate is new: random base64 needs 0.75, words far less.
NOVELTY = 0.6

KINDS = ("assign", "access", "hex", "novel")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed forms, leftmost and without overlap within each kind, as (kind, start, end)."""
    found = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(k in raw for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Novelty:
    """Marginal compressed size against a dictionary of identifiers and the code around a candidate."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        self.identifiers = identifiers.encode()

    def size(self, primed: bytes, content: bytes) -> int:
        dictionary = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=9, dict_data=dictionary, write_content_size=False).compress(content))

    def rate(self, before: str, after: str, candidate: str) -> float:
        """Bytes per character that the candidate adds to what surrounds it."""
        around = (before + "\n" + after).encode("utf-8", "surrogatepass")
        primed = self.identifiers + b"\n" + around
        lead = before[-8:].encode("utf-8", "surrogatepass")
        return (self.size(primed, lead + candidate.encode()) - self.size(primed, lead)) / len(candidate)


def sensitive_ranges(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The lines of the words and ``NEAR`` characters on both sides, which may cross lines; merged."""
    ranges: list[tuple[int, int]] = []
    line_end = -1
    for start, end in words:
        if start > line_end:  # another line than that of the word before
            line_start = text.rfind("\n", 0, start) + 1
            line_end = text.find("\n", end)
            line_end = len(text) if line_end < 0 else line_end
        a, b = max(0, min(line_start, start - NEAR)), max(line_end, end + NEAR)
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
        else:
            ranges.append((a, b))
    return ranges


def pem_bodies(text: str) -> Iterator[tuple[int, int]]:
    """The body that follows each header of a private key; it is looked for before the next header or end line alone,
    so that a text of nothing but headers is read once."""
    headers = [m.span() for m in PEM.finditer(text)]
    ends = [m.start() for m in PEM_END.finditer(text)] if headers else []
    for n, (_, at) in enumerate(headers):
        following = headers[n + 1][0] if n + 1 < len(headers) else len(text)
        k = bisect_left(ends, at)
        stop = ends[k] if k < len(ends) else at + NEAR
        first = PEM_LINE.search(text, at, min(following, stop + LEAST - 1))
        body = PEM_BODY.match(text, first.start(), following) if first and first.start() < stop else None
        if body:
            yield body.span(1)


def is_path(text: str, s: int, e: int) -> bool:
    """Is this run of key-like characters part of an address or a path: words between slashes, or after a scheme?"""
    parts = text[s:e].split("/")
    if len(parts) < 2:
        return False
    before = text[max(0, s - NEAR) : s].split()
    if "://" in text[s:e] or (before and not text[s - 1].isspace() and "://" in before[-1]):
        return True
    words = [p for p in parts if len(p) > 1 and p.isalpha() and (p.islower() or p.istitle())]
    return len(words) > 1 or any(len(w) > 3 for w in words)


def candidates(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]], bool]]:
    """Candidates (start, end) with the pieces that sensitive words and equals signs inside them leave.

    A path is cut at its slashes as well, and is no candidate as a whole, which the last value says.
    """
    words = [m.span() for m in SENSITIVE.finditer(text)]
    ranges = sensitive_ranges(text, words)
    r = w = 0
    for m in CANDIDATE.finditer(text) if ranges else ():
        s, e = m.span()
        while r < len(ranges) and ranges[r][1] <= s:
            r += 1
        if r == len(ranges):
            return
        if ranges[r][0] >= e:
            continue
        while w < len(words) and words[w][1] <= s:
            w += 1
        k = w
        while k < len(words) and words[k][0] < e:
            k += 1
        cuts = words[w:k] + [(s + c.start(), s + c.end()) for c in INNER_EQUALS.finditer(m[0])]
        path = "/" in m[0] and is_path(text, s, e)
        if path:
            cuts += [(i, i + 1) for i in range(s, e) if text[i] == "/"]
        cuts.sort()
        pieces = zip([s, *(b for _, b in cuts)], [*(a for a, _ in cuts), e], strict=True)
        yield s, e, [(a, b) for a, b in pieces if b - a >= LEAST] if cuts else [], not path


def surroundings(text: str, s: int, e: int) -> tuple[str, str]:
    """``CONTEXT`` characters before and after a candidate, without its other occurrences, whole or cut by the edge."""
    word, size = text[s:e], e - s

    def without(lo: int, hi: int) -> str:
        parts, at = [], lo
        found = text.find(word, max(0, lo - size), hi + size)
        while found >= 0:
            if found + size > lo and found < hi:
                parts.append(text[at : max(at, found)])
                at = max(at, found + size)
            found = text.find(word, found + 1, hi + size)
        return "".join([*parts, text[at:hi]])

    return without(max(0, s - CONTEXT), s), without(e, min(len(text), e + CONTEXT))


def everywhere(text: str, found: list[tuple[int, int]], fixed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans and every other occurrence of their strings that no fixed form and no wider span holds.

    Strings are looked up by their first characters at each place of a long run of key-like ones, so that the time does
    not grow with strings times length.
    """
    heads: dict[str, set[str]] = {}
    for s, e in found:
        heads.setdefault(text[s : s + LEAST], set()).add(text[s:e])
    spans = set(found)
    ordered = {h: sorted(w, key=len, reverse=True) for h, w in heads.items()}
    for run in CANDIDATE.finditer(text) if found else ():
        for i in range(run.start(), run.end() - LEAST + 1):
            for word in ordered.get(text[i : i + LEAST], ()):
                if text.startswith(word, i):
                    spans.add((i, i + len(word)))
                    break
    out, furthest, at, reach = [], 0, 0, 0
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        while at < len(fixed) and fixed[at][0] <= s:
            reach = max(reach, fixed[at][1])
            at += 1
        if e > furthest and e > reach:
            out.append((s, e))
            furthest = e
    return out


def novel_spans(text: str, taken: list[tuple[str, int, int]], novelty: Novelty, limit: float = NOVELTY) -> list[tuple[str, int, int]]:
    """Candidates near sensitive words, outside the fixed forms, whose marginal rate reaches the limit."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if not any(w in raw for w in SENSITIVE_WORDS):
        return []
    bounds = sorted((a, b) for _, a, b in taken)
    found: list[tuple[int, int]] = []

    known: set[str] = set()

    def novel(s: int, e: int) -> bool:
        word = text[s:e]
        if word in known:
            return True
        mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
        if mixed and novelty.rate(*surroundings(text, s, e), word) >= limit:
            known.add(word)
            return True
        return False

    for s, e in pem_bodies(text):
        if novel(s, e):
            found.append((s, e))
    bounds = sorted(bounds + found)
    furthest, at = 0, 0
    for s, e, pieces, whole in candidates(text):
        while at < len(bounds) and bounds[at][0] < e:
            furthest = max(furthest, bounds[at][1])
            at += 1
        if furthest > s:
            continue
        new = [p for p in pieces if novel(*p)]
        if new:
            found.append((new[0][0], new[-1][1]))
        elif whole and novel(s, e):
            found.append((s, e))
    fixed = sorted((a, b) for _, a, b in taken)
    return [("novel", s, e) for s, e in everywhere(text, found, fixed)]


def spans_of(text: str | None, novelty: Novelty) -> list[tuple[str, int, int]]:
    """All spans in order: by start, then by kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with every run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


SPAN = "array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [spans_of(t, novelty) for t in texts]
            clean = [redacted(t, s, mark) if s else t for t, s in zip(texts, found, strict=True)]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(clean, pa.string()), pa.array(rows, _SPAN)],
                [*batch.schema.names[:-1], "clean_text", "spans"])

    return run


def find_secrets(docs: DataFrame, mark: str = "[secret]", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: the columns of ``keep``, clean_text (spans replaced by ``mark``) and spans.

    Spans are (kind, start, end) in code points, end exclusive, by start, then in the order assign, access, hex, novel.
    Null text has none and stays null; an empty text stays empty.  Rows are judged one by one, whatever their ids; an
    empty table gives an empty one.  There is no shuffle.
    """
    rows = docs.select(*keep, F.col("text").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("text").dtypes)
    return rows.mapInArrow(_scan(mark), f"{schema}, clean_text string, spans {SPAN}")


def without_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with secrets blotted out; other columns stay, ``n_chars`` follows the text."""
    others = tuple(c for c in docs.columns if c != "text")
    found = find_secrets(docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(others)), "text"), mark,
                         tuple(f"_{i}" for i in range(len(others))))
    place = {c: F.col(f"_{i}") for i, c in enumerate(others)} | {"text": F.col("clean_text")}
    changed = F.size("spans") > 0
    if "n_chars" in place:
        place["n_chars"] = F.when(changed, F.length("clean_text")).otherwise(place["n_chars"])
    kinds = dict(docs.dtypes)
    return found.select(*(place[c].cast(kinds[c]).alias(c) for c in docs.columns))

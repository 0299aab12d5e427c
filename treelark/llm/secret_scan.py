"""Secret scans: spans by fixed patterns, and values in credential contexts that would be hard to guess.

Three kinds are patterns: `assign` (a credential name, a sign and a value), `access` (access key ids) and `hex` (long hexadecimal runs). The kind
`guess` is found by cost: wherever a text gives something as a credential (after a name and a sign, in a URL's user part, in a tag, after a command
line flag, or said in a sentence), the value is cut into segments so that the guesses they need are fewest, by dynamic programming over its
positions. A segment is a word of the dictionary (in any case, with digits and signs for letters), a word of the value's own making, a date or
year, a repeated unit, a walk on a keyboard, or a span of brute force, which costs the logarithm of the alphabet in use a character. A value of
GUESS_BITS bits or more is a span of its own; words, dates and placeholders after a credential's name stay clean. Values are scored whole, whatever their length.

The dictionary are the words of the corpus that most documents hold, DICTIONARY at most, by rank: counted over all documents, each task sums its own
before anything is shuffled, and what is broadcast has a fixed number of words of WORD_LETTERS letters at most. Texts are searched for the literals that any span must begin
with, and patterns are tried at those places only.

Null and empty texts have no spans. Bytes that are no UTF-8 count as replacement characters. Very long texts are read whole, in pieces of a batch.
Ties between segmentations don't matter: only the cost is used. Repeated rows get equal spans. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelark.llm.common import BATCH_ROWS, Workspace, annotate

KINDS = ["assign", "access", "hex", "guess"]
GUESS_BITS = 36.0
DICTIONARY, WORD_LETTERS = 20_000, 24
#: Distinct words that a task holds before it hands its counts on.
HELD_WORDS = 200_000

VERDICT = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

ASCII_CASE = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ASCII_CASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Names that introduce a credential. Those of the second list count only where no letter precedes them.
NAMES = ["password", "passwd", "passphrase", "passcode", "secret", "token", "apikey", "api_key", "api-key", "api key", "access_key", "access-key", "access key", "private_key", "private-key", "credential"]
SHORT_NAMES = ["pass", "pwd", "auth", "authorization", "bearer"]
_NAME = "|".join(map(re.escape, sorted(NAMES + SHORT_NAMES, key=len, reverse=True)))
#: After a name: closing marks, then a sign, a tag's end or a word of a sentence, then the value.
GIVEN = re.compile(rf"""(?:{_NAME})(?:s|[0-9]{{1,4}}|[_-][a-z0-9_-]{{0,32}})?(?:["'\]`)]*\s?\s?(?P<sign>:=|=>|==?|:|>)|(?P<said>\s(?:is|was|equals)|\s))\s?\s?(?:(?P<quote>["'`])(?P<quoted>[^\s"'`]+)(?P=quote)|(?P<bare>[^\s"'`<>,;]+))""", ASCII_CASE)
USER_PART = re.compile(r"://[^\s/:@]+:(?P<value>[^\s/@]+)@")
#: What may end a sentence or close a bracket behind a bare value.
CLOSING = ".,;:!?)]}"

# Placeholders and the passwords that are tried first, most common first.
COMMON = "password 123456 admin welcome letmein secret changeme default guest login master root user test example sample dummy placeholder none null true false required missing invalid yourpassword yourtoken mypassword".split()
# Rows of keyboards and ordered alphabets on which walks are made, and the signs of shifted digits.
BOARDS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "qaz", "wsx", "edc", "rfv", "tgb", "yhn", "ujm", "1qaz", "2wsx", "3edc", "4rfv", "789", "456", "123", "abcdefghijklmnopqrstuvwxyz", "01234567890"]
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))
# Characters that stand for letters.
STAND_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}

#: Bits of the choice of a pattern for a segment, of a word outside the dictionary, of a step in another direction.
SEGMENT, UNLISTED, TURN = 2.0, 20.0, 3.0
YEARS = range(1900, 2100)
YEAR, DAY = math.log2(len(YEARS)), math.log2(len(YEARS) * 366)
DATES = [re.compile(x) for x in (r"(?P<y>\d{4})(?P<s>[-/._]?)(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})", r"(?P<d>\d{1,2})(?P<s>[-/._]?)(?P<m>\d{1,2})(?P=s)(?P<y>\d{4})", r"(?P<m>\d{1,2})(?P<s>[-/._]?)(?P<d>\d{1,2})(?P=s)(?P<y>\d{4})", r"(?P<y>\d{4})")]
#: Longest unit of a repetition.
UNIT = 32

Segment = tuple[int, int, float, str]


def alphabet_bits(value: str) -> float:
    """Bits of one character of brute force: the classes of characters that the value uses."""
    sizes = {"0": 10, "a": 26, "A": 26, "!": 33, "x": 100}
    used = {"0" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "!" if c < "\x7f" else "x" for c in value}
    return math.log2(sum(sizes[c] for c in used)) if used else 0.0


def case_bits(word: str) -> float:
    """Choices of upper-case letters: none, the first, all, or any so many of them."""
    upper, n = sum(c.isupper() for c in word), sum(c.isalpha() for c in word)
    if not upper:
        return 0.0
    return 1.0 if upper == n or (upper == 1 and word[0].isupper()) else math.log2(sum(math.comb(n, k) for k in range(1, min(upper, n - upper) + 1)) + 1)


def words_in(value: str, ranks: dict[str, int]) -> Iterator[Segment]:
    low = value.lower() if len(value.lower()) == len(value) else value
    plain = "".join(STAND_FOR.get(c, c) for c in low)
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + WORD_LETTERS) + 1):
            for form, extra in ((low, 0.0), (plain, 1.0)) if low[i:j] != plain[i:j] else ((low, 0.0),):
                if (rank := ranks.get(form[i:j])) is not None:
                    swapped = sum(a != b for a, b in zip(low[i:j], form[i:j], strict=True))
                    yield i, j, math.log2(rank + 1) + case_bits(value[i:j]) + extra * swapped, "word"
    for m in re.finditer(r"[^\W\d_]{2,}", value):  # a letter, and lower-case letters after it
        word = m.group()
        if len(word) <= WORD_LETTERS and (word[1:].islower() or word[1:].lower() == word[1:].upper()):
            yield m.start(), m.end(), UNLISTED + case_bits(word), "word"


def dates_in(value: str) -> Iterator[Segment]:
    for form in DATES:
        for i in range(len(value)):
            if m := form.match(value, i):
                g = m.groupdict()
                if int(g["y"]) in YEARS and ("m" not in g or (1 <= int(g["m"]) <= 12 and 1 <= int(g["d"]) <= 31)):
                    yield i, m.end(), YEAR if "m" not in g else DAY + (2.0 if g["s"] else 0.0), "date"


def repeats_in(value: str, unit_bits: float) -> Iterator[Segment]:
    """Whole repetitions of a unit, from the first place at which its period holds."""
    n = len(value)
    for p in range(1, min(UNIT, n // 2) + 1):
        start = 0
        for k in range(n - p + 1):
            if k < n - p and value[k] == value[k + p]:
                continue
            times = (k - start) // p + 1
            if times >= 2 and times * p >= 3:
                yield start, start + times * p, p * unit_bits + math.log2(times), "repeat"
            start = k + 1


@functools.lru_cache(maxsize=1)
def neighbours() -> dict[tuple[str, str], tuple[int, int]]:
    """Pairs of characters that lie beside each other: on which board and in which direction."""
    found: dict[tuple[str, str], tuple[int, int]] = {}
    for k, row in enumerate(BOARDS):
        for a, b in zip(row, row[1:], strict=False):
            found.setdefault((a, b), (k, 1))
            found.setdefault((b, a), (k, -1))
    return found


def walks_in(value: str) -> Iterator[Segment]:
    """Maximal runs of three or more neighbouring keys."""
    keys = [SHIFTED.get(c, c.lower()) for c in value]
    near, i = neighbours(), 0
    while i + 2 < len(keys):
        j, turns, way = i, 0, None
        while j + 1 < len(keys) and (step := near.get((keys[j], keys[j + 1]))):
            turns += way is not None and step != way
            way, j = step, j + 1
        if j - i >= 2:
            shifted = sum(SHIFTED.get(c, c.lower()) != c for c in value[i : j + 1])
            yield i, j + 1, math.log2(47 * 2) + math.log2(j - i + 1) + TURN * turns + min(shifted, j + 1 - i - shifted), "walk"
        i = max(j, i + 1)


def segments_of(value: str, ranks: dict[str, int]) -> list[Segment]:
    """All segments but brute force: start, end, bits, pattern."""
    return [*words_in(value, ranks), *dates_in(value), *repeats_in(value, alphabet_bits(value)), *walks_in(value)]


def guess_bits(value: str, ranks: dict[str, int]) -> tuple[float, list[tuple[int, int, str]]]:
    """The bits of the cheapest segmentation of a value, and its segments."""
    n, brute = len(value), alphabet_bits(value)
    ending: dict[int, list[Segment]] = {}
    for s in segments_of(value, ranks):
        ending.setdefault(s[1], []).append(s)
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]  # cost of a prefix, where its last segment begins, and what it is
    opened: tuple[float, int] = (math.inf, 0)  # cost of a prefix that ends in a span of brute force, and where that begins
    for j in range(1, n + 1):
        opened = min(opened, (best[j - 1][0] + SEGMENT, j - 1))
        opened = (opened[0] + brute, opened[1])
        choices = [(best[i][0] + SEGMENT + bits, i, kind) for i, _, bits, kind in ending.get(j, [])]
        best.append(min([(*opened, "brute"), *choices]))
    found, j = [], n
    while j:
        _, i, kind = best[j]
        found.append((i, j, kind))
        j = i
    return best[n][0], found[::-1]


def places(low: str, names: list[str]) -> list[int]:
    """Where any of the names begins, in order."""
    found = set()
    for name in names:
        at = low.find(name)
        while at >= 0:
            found.add(at)
            at = low.find(name, at + 1)
    return sorted(found)


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    found, end = [], 0
    for at in places(low, ["password", "passwd", "secret", "token", "apikey", "api_key"]):
        if at >= end and (m := ASSIGN.match(text, at)):
            end = m.end()
            if len(m.group(2)) >= 6:
                found.append(("assign", at, end))
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def credential_values(text: str, low: str) -> Iterator[tuple[int, int]]:
    """Spans of the values that the text gives as credentials, each once, from left to right."""
    end = 0
    for at in places(low, NAMES + SHORT_NAMES):
        inside = at > 0 and text[at - 1].isalpha() and not low.startswith(tuple(NAMES), at)
        if at < end or inside or not (m := GIVEN.match(text, at)):
            continue
        part = "quoted" if m["quoted"] else "bare"
        a, b = m.span(part)
        while part == "bare" and b > a and text[b - 1] in CLOSING:
            b -= 1
        value = text[a:b]
        # in a sentence, only what no word looks like; a lone space joins a flag or a scheme to its value
        if m["said"] is not None and (m["said"].isspace() and not (low.startswith("bearer", at) or text[max(0, at - 2) : at].endswith("-")) or value.isalpha() or value.isdigit()):
            continue
        if b > a and value.lower() not in SHORT_NAMES:  # a scheme's name, as in `Authorization: Bearer ...`, is no value
            yield a, b
            end = b
    at = low.find("://")
    while at >= 0:
        m = USER_PART.match(text, at)
        if m:
            yield m.span("value")
        at = low.find("://", m.end() if m else at + 3)


def spans_of(text: str, ranks: dict[str, int], least: float = GUESS_BITS) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by start, then kind; code points, end exclusive."""
    low = text.encode().lower().decode()  # A-Z only, so that places stay
    found = {*base_spans(text, low)}
    found |= {("guess", a, b) for a, b in credential_values(text, low) if guess_bits(text[a:b], ranks)[0] >= least}
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """Ranks of common passwords and of the words of the corpus that c documents or more hold, `size` of them at most, of bounded length.

    c is the lowest of the steps 2^(k/8) over 1 with so few words; it is found from the number of words by step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            words = [w for w in held if 3 <= len(w) <= WORD_LETTERS]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.update(set(t.translate(LETTERS).split()))
                if len(held) > HELD_WORDS:
                    yield handed()
                    held.clear()
        yield handed()

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    part = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n bigint")
    ws = Workspace(docs.sparkSession)
    counted = ws.save(part.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "words")
    most = sorted(((r["step"], r["count"]) for r in counted.groupBy("step").count().collect()), reverse=True)  # some 500 steps at most
    least, words = 1 << 30, 0
    for step, count in most:
        if (words := words + count) > size:
            break
        least = step
    top = sorted((-r["n"], bytes(r["word"])) for r in counted.where(F.col("step") >= least).collect())
    ws.drop("words")
    ranks: dict[str, int] = {}
    for w in [*COMMON, *(w.decode("utf-8", "replace") for _, w in top)]:
        ranks.setdefault(w, len(ranks))
    return ranks


def scan(docs: DataFrame, ranks: dict[str, int] | None = None, least: float = GUESS_BITS, keep: list[str] | None = None) -> DataFrame:
    """(row, verdict) for every document: spans by kind, the digest of those by pattern, and all spans. ranks: by default those of docs."""
    ranks = dictionary(docs) if ranks is None else ranks
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batch: dict[str, pa.Array]) -> dict[str, object]:
        found: dict[str, list] = {f.name: [] for f in VERDICT}
        known = shared.value
        for t in batch["text"]:
            spans = spans_of((t.as_py() or b"").decode("utf-8", "replace"), known, least)
            kinds = Counter(k for k, _, _ in spans)
            for k in KINDS:
                found[f"n_{k}"].append(kinds[k])
            said = [(k, f"{k}:{a}:{b}") for k, a, b in spans]
            found["base_sha256"].append(hashlib.sha256(",".join(s for k, s in said if k != "guess").encode()).hexdigest())
            found["spans"].append(",".join(s for _, s in said))
        return found

    return annotate(docs, {"text": "cast(text as binary)"}, VERDICT, run, keep)

"""Personal data by weak supervision: three labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the matches of the strict patterns (kept or dropped by their number rules) and of looser ones that overlap
no kept match: addresses spelled out, IPv6 addresses, card numbers with other separators, phone numbers without a plus
sign. Each labeler votes for (1), against (-1) or not at all (0). The pattern labeler votes on strict matches by their
number rule. The gazetteer labeler knows endings of names (generic ones, and any of two letters as a country's) and of
files, address blocks, the number ranges and lengths of card issuers, calling codes, and the form of North American
numbers. The context labeler looks for cue words just before the span. Expectation-maximisation over the counts of all
vote patterns of a kind estimates how reliable each labeler is, from PRIOR votes that trust it moderately, and a logistic
span classifier is trained on votes and shape of all candidates with the resulting probabilities as targets. Strict
matches always stay; other candidates are added if the classifier gives 0.5 or more, they overlap no span that is there
already, and stand first from the left; a strict match that fails its
rule, and a span after a cue word against (`order`, `isbn`), is never added.

Only counts by (kind, votes, shape) come to the driver: at most 4 x 27 x 24 rows, whatever the corpus. Null texts count
as empty; texts without data give zero counts and the hash of an empty string. Equal rows give equal rows. Very long
texts are read whole in linear time. Other columns play no part (a stage passes them through). An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, small_batches, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_EMAIL_AT = re.compile(rf"[{_LOCAL}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The same from the first character of a run of name characters only; other starts in the run fail as the first does.
_EMAIL = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPELLED = re.compile(r"[ (\[](?:dot|at)[ )\]]")
_LOOSE_EMAIL = re.compile(
    rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}(?:(?:@| ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]{{1,63}}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]{{1,63}})+"
    r"| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63})+)"
)
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{6,39}(?![0-9A-Za-z:])")
_LOOSE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([./_])[0-9]{6}\2[0-9]{4,5})(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+(])(?:00[1-9][0-9]{0,2}[ .(/-][0-9 .()/-]{5,18}[0-9]|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])")
# Generic endings of names; endings of files that are no names; calling codes (a range of third digits
# where given); first digits of card numbers with their lengths.
_ENDINGS = frozenset("com org net edu gov mil int info biz name pro aero asia cat coop jobs mobi museum tel travel post arpa xyz online site store shop app dev cloud email blog tech news live "
    "club world today space agency digital media group life work host website company network center solutions systems services consulting academy".split())  # fmt: skip
_FILES = frozenset("png jpg jpeg gif svg webp css js json html htm php asp xml txt md pdf zip gz exe py sh csv doc docx xls xlsx mp3 mp4".split())
_CALLING = (
    "1", "7", "20", "21[12368]", "22[0-9]", "23[0-9]", "24[0-9]", "25[0-8]", "26[0-9]", "27", "29[01789]", "30", "31", "32", "33", "34", "35[0-9]", "36", "37[0-8]", "38[0-79]", "39", "40", "41", "42[013]",
    "43", "44", "45", "46", "47", "48", "49", "50[0-9]", "51", "52", "53", "54", "55", "56", "57", "58", "59[0-9]", "60", "61", "62", "63", "64", "65", "66", "67[02-9]", "68[0-35-9]", "69[012]", "80[08]", "81", "82", "84",
    "85[02356]", "86", "87[08]", "88[0-368]", "90", "91", "92", "93", "94", "95", "96[0-8]", "97[0-79]", "98", "99[2-68]",
)
_ISSUERS = (
    ("4", (13, 16, 19)), ("5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720", (16,)), ("3[47]", (15,)), ("30[0-5]|3095|36|3[89]", (14, 16, 19)), ("35(2[89]|[3-8])", (16, 17, 18, 19)),
    ("6011|64[4-9]|65|62|81", (16, 17, 18, 19)), ("220[0-4]", (16, 17, 18, 19)), ("50|5[6-8]|6", (12, 13, 14, 15, 16, 17, 18, 19)),
)
_CALLED = re.compile("(?:" + "|".join(_CALLING) + ")")
_ISSUED = [(re.compile(p), sizes) for p, sizes in _ISSUERS]
_AMERICAN = re.compile("[2-9][0-8][0-9][2-9][0-9]{6}")
_CUES = {
    "email": frozenset("email e-mail mail mailto contact address write from to reply".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address client addr gateway dns from".split()),
    "card": frozenset("card visa mastercard amex credit debit payment pay number cc account".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact number whatsapp".split()),
}
_AGAINST = frozenset("id order invoice version release isbn issn doi ref page part serial sku model section figure build".split())
_NUMBER_END = re.compile(r"[^0-9]")
#: Votes that each labeler is taken to have cast before any is counted, on spans that are data and on others, and each
#: labeler's shares of votes against, of none and for among those on data (on others the other way round). A cue word
#: against, such as `order`, seldom stands before data.
PRIOR, SHARES = 20.0, ((0.05, 0.45, 0.5), (0.05, 0.45, 0.5), (0.01, 0.74, 0.25))
#: What a vote of each labeler adds to or takes from even odds before the first round.
FIRST = (0.15, 0.15, 0.3)


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool
    votes: tuple[int, int, int]
    shape: int


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while (m := (at and _EMAIL_AT.match(text, at)) or _EMAIL.search(text, at)) is not None:
        yield m.start(), m.end()
        at = m.end()


def strict(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes its number rule) of every match of the strict patterns."""
    found = [(0, a, b, True) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return found
    for m in _IP.finditer(text):
        found.append((1, m.start(), m.end(), all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NUMBER_END.sub("", m[0])
            if len(digits) >= 12:
                found.append((2, m.start(), m.end(), len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            found.append((3, m.start(), m.end(), 9 <= len(_NUMBER_END.sub("", m[0])) <= 15))
    return found


def _is_ipv6(span: str) -> bool:
    if span.count(":") < 2:
        return False
    try:
        return ipaddress.IPv6Address(span).version == 6
    except ValueError:
        return False


def loose(text: str) -> Iterator[tuple[int, int, int]]:
    if _SPELLED.search(text):
        yield from ((0, m.start(), m.end()) for m in _LOOSE_EMAIL.finditer(text))
    if _DIGIT.search(text) is None:
        return
    if ":" in text:
        yield from ((1, m.start(), m.end()) for m in _LOOSE_IP.finditer(text) if _is_ipv6(m[0]))
    for kind, pattern in ((2, _LOOSE_CARD), (3, _LOOSE_PHONE)):
        yield from ((kind, m.start(), m.end()) for m in pattern.finditer(text))


def _gazetteer(kind: int, span: str) -> int:
    digits = _NUMBER_END.sub("", span[:64])
    if kind == 0:
        ending = re.split(r"[^A-Za-z0-9]+", span.rstrip(")]"))[-1].lower()
        return -1 if ending in _FILES else int(ending in _ENDINGS or len(ending) == 2 and ending.isalpha())
    if kind == 1:
        if ":" in span:
            return 1 if re.match("[23][0-9a-f]{3}:|fe[89ab]|f[cd]", span.lower()) else -1
        first = span.split(".", 1)[0].lstrip("0") or "0"
        return 1 if len(first) < 4 and 0 < int(first) < 224 and first != "127" else -1
    if kind == 2:
        return 1 if luhn(digits) and any(len(digits) in sizes and p.match(digits) for p, sizes in _ISSUED) else -1
    if span[:1] == "+" or digits[:2] == "00":
        number = digits.removeprefix("00")
        return 1 if 9 <= len(number) <= 15 and _CALLED.match(number) else -1
    return 1 if _AMERICAN.fullmatch(digits) else -1


def _context(kind: int, text: str, start: int) -> int:
    before = re.split(r"[^a-z0-9-]+", text[max(0, start - 32) : start].lower())[-5:]
    if any(w in _AGAINST for w in before):
        return -1
    return int(any(w in _CUES[KINDS[kind]] for w in before))


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text; those with base=True are the strict matches that pass."""
    rows = [(k, a, b, ok, 1 if ok else -1) for k, a, b, ok in strict(text)]
    kept = sorted((a, b) for _, a, b, ok, _ in rows if ok)
    taken = {(k, a, b) for k, a, b, *_ in rows}
    ends = list(accumulate((b for _, b in kept), max))
    for k, a, b in loose(text):
        before = bisect_left(kept, (b, 0))  # kept matches that begin before the end
        if (k, a, b) not in taken and not (before and ends[before - 1] > a):
            rows.append((k, a, b, False, 0))
    out = []
    for k, a, b, ok, vote in rows:
        span = text[a:b]
        size = min(3, (b - a) // 8)
        marks = min(5, sum(not c.isalnum() for c in span[:64]))
        out.append(Candidate(k, a, b, ok, (vote, _gazetteer(k, span), _context(k, text, a)), size * 6 + marks))
    return out


class SpanModel:
    """EM over vote patterns, then a logistic classifier; a table from (kind, votes, shape) to a probability."""

    def __init__(self, counts: list[tuple[int, tuple[int, int, int], int, int]]):
        self.p: dict[tuple[int, tuple[int, int, int], int], float] = {}
        for kind in range(len(KINDS)):
            rows = sorted((v, s, n) for k, v, s, n in counts if k == kind)
            if rows:
                self._fit(kind, rows)

    @staticmethod
    def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
        """The probability of each vote pattern's spans to be personal data."""
        p = np.clip(0.5 + votes @ np.array(FIRST), 0.05, 0.95)
        for _ in range(rounds):
            prior = float(np.clip((p * n).sum() / n.sum(), 0.1, 0.9))
            log = np.tile(np.log([1 - prior, prior]), (len(votes), 1))
            for j in range(votes.shape[1]):
                for z, w in enumerate((n * (1 - p), n * p)):
                    share = np.array([w[votes[:, j] == v].sum() + PRIOR * SHARES[j][v + 1 if z else 1 - v] for v in (-1, 0, 1)])
                    log[:, z] += np.log(share / share.sum())[votes[:, j] + 1]
            p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
        return p

    def _fit(self, kind: int, rows: list) -> None:
        votes = np.array([v for v, _, _ in rows])
        n = np.array([c for _, _, c in rows], float)
        target = self.reliabilities(votes, n)
        x = np.concatenate([np.ones((len(rows), 1)), votes, votes == 0, np.eye(24)[[s for _, s, _ in rows]]], axis=1)
        w, weight = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(100):  # Newton steps on the regularised cross entropy
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
            w -= np.linalg.solve(h, x.T @ (weight * (q - target)) + 1e-3 * w)
        for (v, s, _), q in zip(rows, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True):
            self.p[kind, tuple(v), s] = float(q)

    def spans(self, found: list[Candidate]) -> list[tuple[int, int, int, bool]]:
        """(start, kind, end, base) of all spans by start, then kind."""
        kept = [(c.start, c.kind, c.end, True) for c in found if c.base]
        if len(kept) < len(found):
            last = 0  # candidates overlap no strict match, so only each other
            for c in sorted((c for c in found if not c.base and c.votes[0] >= 0 and c.votes[2] >= 0), key=lambda c: (c.start, c.kind, c.end)):
                if self.p.get((c.kind, tuple(c.votes), c.shape), 0.0) >= 0.5 and c.start >= last:
                    kept.append((c.start, c.kind, c.end, False))
                    last = c.end
        return sorted(kept)


_FOUND = "doc_id long, kind array<int>, first array<int>, last array<int>, base array<boolean>, votes array<int>, shape array<int>"


def find(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and its candidates as parallel arrays (votes as a number from 0 to 26)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [candidates(t.as_py() or "") for t in batch.column(1)]
            lists = [[[c.kind for c in r] for r in rows], [[c.start for c in r] for r in rows], [[c.end for c in r] for r in rows], [[c.base for c in r] for r in rows], [[_packed(c.votes) for c in r] for r in rows], [[c.shape for c in r] for r in rows]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True))], ["doc_id", "kind", "first", "last", "base", "votes", "shape"])

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


def _packed(votes: tuple[int, int, int]) -> int:
    return (votes[0] + 1) * 9 + (votes[1] + 1) * 3 + votes[2] + 1


def _unpacked(n: int) -> tuple[int, int, int]:
    return n // 9 - 1, n // 3 % 3 - 1, n % 3 - 1


def learn(found: DataFrame) -> SpanModel:
    """The model from the candidates of all documents."""
    each = found.select(F.explode(F.arrays_zip("kind", "votes", "shape")).alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    return SpanModel([(r["kind"], _unpacked(r["votes"]), r["shape"], r["count"]) for r in each.collect()])


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def report(found: DataFrame, model: SpanModel) -> DataFrame:
    def text(spans: list) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                spans = model.spans([Candidate(k, a, b, ok, _unpacked(v), s) for k, a, b, ok, v, s in zip(r["kind"], r["first"], r["last"], r["base"], r["votes"], r["shape"], strict=True)])
                base = [x for x in spans if x[3]]
                out.append((r["doc_id"], *(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(text(base).encode()).hexdigest(), text(spans)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.mapInArrow(run, RESULT)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(find(table(spark, sf_dir, "documents")))
    return report(found, learn(found))


def mask(text: str, model: SpanModel) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first and longest."""
    out, at = [], 0
    for a, k, b, _ in sorted(model.spans(candidates(text)), key=lambda s: (s[0], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, personal data masked in their texts and n_chars set anew."""
    model, at = learn(find(docs)), docs.columns.index("text")
    sizes = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [None if t is None else mask(t, model) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at).with_type(pa.string()), pa.array(texts, pa.string()))
            if sizes is not None:
                n = pa.array([old if t is None else len(t) for t, old in zip(texts, batch.column(sizes).to_pylist(), strict=True)], pa.int64())
                batch = batch.set_column(sizes, batch.schema.field(sizes), n.cast(batch.schema.field(sizes).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)

"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Spans of four kinds (email, ip, card, phone) are proposed by the base patterns and by wider ones
(spelled-out addresses, IPv6 and defanged addresses, numbers grouped otherwise or without a
plus).  Six labelers vote for, against or not at all on each: a pattern of the usual shape, the
base pattern, a check (Luhn, parts, lengths), a gazetteer (top-level domains, issuers, calling
codes, unicast ranges), words before the span that announce its kind, and signs of something
else.  How often each combination of votes occurs is counted in Spark (at most 4 * 3^6 rows);
expectation-maximisation finds from that how reliable each labeler is, and how likely each
combination is personal data.  A logistic classifier on the span's shape and surroundings learns
these probabilities from ``sample`` different spans of each kind at most, weighted by how
often they occur, and decides on every proposed span of the table.

Base spans always stay.  A wider span is added where the classifier gives ``threshold`` or more
and it overlaps no base span and no added span before it.

All scans are linear in the text.  Null and empty texts have no spans; ids may be null and rows
repeated, each gives its row.  Columns beside id and text are ignored, whatever their names.  An
empty table gives an empty result; a table without proposed spans adds none.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("shape", "base", "check", "gazetteer", "words before", "something else")
SAMPLE, THRESHOLD = 20_000, 0.9
FEATURES = 1 << 12
#: Code points looked at before and after a span.
BEFORE, AFTER = 48, 12

# What the gazetteer and the context labelers know.
DOMAINS = frozenset("com org net edu gov mil int info biz io eu uk de fr es it nl be ch at pl se no dk fi pt cz ie us ca au nz jp cn in br mx ru".split())
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65|35")
ANNOUNCE = (
    frozenset("email e-mail mail mailto contact write address courriel correo kontakt".split()),
    frozenset("ip ipv4 ipv6 host server address addr client login from".split()),
    frozenset("card visa mastercard amex credit debit cc pan carte tarjeta karte kreditkarte".split()),
    frozenset("phone tel telephone call mobile cell fax whatsapp sms téléphone teléfono telefon appel llame".split()),
)
ELSE = frozenset("version v ver isbn issn id no nr order invoice serial code sku date year page price total sum section chapter".split())

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?[\[({](?:at|@)[\])}] ?| at ", re.I)
_SPELLED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({](?:dot|\.)[\])}] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}", re.I)
_DOT_SAID = re.compile(r"[\[({](?:dot|\.)[\])}]| dot ", re.I)
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\.)[0-9]{1,3}){3}(?![0-9])", re.I)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_FOUND = "doc_id long, base string, found array<struct<kind:int,at:int,until:int,base:boolean,votes:string,x:array<int>>>"
_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: as many signs before as may stand there since the last match, the longest domain after."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _chains(text: str, runs: list[tuple[int, int]], between: str, gap: int) -> Iterator[tuple[int, int, int]]:
    """Longest rows of digit runs with at most ``gap`` signs of ``between`` from one to the next."""
    i = 0
    while i < len(runs):
        start, end = runs[i]
        digits = end - start
        i += 1
        while i < len(runs) and runs[i][0] - end <= gap and all(c in between for c in text[end : runs[i][0]]):
            digits += runs[i][1] - runs[i][0]
            end = runs[i][1]
            i += 1
        yield start, end, digits


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    if runs is None:
        runs = [m.span() for m in _DIGITS.finditer(text)]
    out = [(EMAIL, a, b) for a, b in _emails(text)]
    if runs:
        out += [(IP, a, b) for a, b in _ips(text)]
        out += [(CARD, a, b) for a, b, n in _chains(text, runs, " -", 1) if 13 <= n <= 19 and luhn(_digits(text[a:b]))]
        out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def wide_spans(text: str, runs: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further proposals that overlap no base span, by start."""
    out = []
    for m in _AT.finditer(text):
        start = m.start()
        while start > max(m.start() - 64, 0) and text[start - 1] in _LOCAL:
            start -= 1
        host = _SPELLED.match(text, m.end()) if start < m.start() else None
        if host and (m.group() != m.group().strip(" atAT") or _DOT_SAID.search(host.group())):
            out.append((EMAIL, start, host.end()))
    if runs:
        out += [(IP, *m.span()) for m in _DEFANGED.finditer(text)]
    if "::" in text or text.count(":") > 6:
        out += [(IP, *m.span()) for m in _IPV6.finditer(text)]
    for a, b, n in _chains(text, runs, " -./\n", 2):
        if 13 <= n <= 19:
            out.append((CARD, a, b))
    for a, b, n in _chains(text, runs, " ().-/", 3):
        if 9 <= n <= 15:
            out.append((PHONE, a - 1 if a and text[a - 1] == "(" and ")" in text[a:b] else a, b))
    taken: list[list[int]] = []  # base spans of different kinds may overlap each other
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts, free = [a for a, _ in taken], []
    for kind, a, b in sorted(out, key=lambda s: (s[1], s[0], s[2])):
        i = bisect.bisect_left(starts, b) - 1
        if i < 0 or taken[i][1] <= a:
            free.append((kind, a, b))
    return free


def _shape(span: str) -> str:
    """Letters as a, digits as 0, equal signs in a row as one with their number."""
    out, last, n = [], "", 0
    for c in span[:64]:
        c = "0" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if c != last and last:
            out.append(f"{last}{n}")
            n = 0
        last, n = c, n + 1
    return "".join(out) + f"{last}{n}"


_USUAL = (
    re.compile(r"[^.@ ][^@ ]*@(?:[a-z0-9-]+\.)+[a-z]{2,}", re.I),
    re.compile(r"(?:[0-9]{1,3}(?:\.|\[\.\]|\(\.\)|\[dot\])){3}[0-9]{1,3}|[0-9a-f:]{8,}", re.I),
    re.compile(r"[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}"),
    re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{9,15}|00[0-9 ]{9,15}"),
)


def votes_of(kind: int, span: str, base: bool, before: list[str], close: str, after: str) -> tuple[int, ...]:
    """For (1), against (-1) or neither (0), of each labeler."""
    digits = _digits(span)
    shape = 1 if _USUAL[kind].fullmatch(span) else -1
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z0-9-]+|(?i: dot )", span)[-1].lower()
        check = -1 if ".." in span or span[0] == "." else 1
        known = 1 if last in DOMAINS else -1 if not last.isalpha() else 0
    elif kind == IP:
        parts = _DIGITS.findall(span)
        plain = ":" not in span
        check = 0 if not plain else 1 if all(len(p) <= 3 and int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts) else -1
        known = 0 if not plain else 1 if len(parts[0]) <= 3 and 1 <= int(parts[0]) <= 223 and max(map(len, parts)) > 1 else -1
    elif kind == CARD:
        check = 1 if luhn(digits) else -1
        known = 1 if ISSUERS.match(digits) else -1
    else:
        check = 1 if 10 <= len(digits) <= 13 else -1 if len(_DIGITS.findall(span)) > 5 else 0
        given = digits if span[0] == "+" else digits[2:] if digits.startswith("00") else ""
        known = (1 if given.startswith(CALLING) else -1) if given else 0
    said = 1 if ANNOUNCE[kind].intersection(before) else 0
    other = -1 if ELSE.intersection(before[-2:]) or close in "$€£#=/\\_" and close or after in "%/=_" and after else 0
    return shape, 1 if base else 0, check, known, said, other


def _features(kind: int, span: str, votes: tuple[int, ...], before: list[str], close: str, after: str) -> list[int]:
    digits = _digits(span)
    known = [
        "bias", f"shape {_shape(span)}", f"digits {len(digits)}", f"groups {len(_DIGITS.findall(span))}",
        f"first {digits[:2]}" if kind != EMAIL else f"end {span[-4:].lower()}", f"close {close}", f"after {after}",
        *(f"vote {i} {v}" for i, v in enumerate(votes) if i in (0, 2, 3)), *(f"word {w}" for w in before[-3:]),
    ]
    return sorted({zlib.crc32(f"{kind} {x}".encode()) % FEATURES for x in known})


def proposals(text: str | None) -> tuple[list, list]:
    """The base spans, and all proposed spans with their votes and features."""
    if not text:
        return [], []
    runs = [m.span() for m in _DIGITS.finditer(text)]
    base = base_spans(text, runs)
    if not runs and not base and "at" not in text.lower():
        return [], []
    found = []
    for part, is_base in ((base, True), (wide_spans(text, runs, base), False)):
        for kind, a, b in part:
            span, close, after = text[a:b], text[a - 1 : a].strip(), text[b : b + 1].strip()
            before = _WORD.findall(text[max(a - BEFORE, 0) : a].lower())
            votes = votes_of(kind, span, is_base, before, close, after)
            found.append({
                "kind": kind, "at": a, "until": b, "base": is_base,
                "votes": "".join("-0+"[v + 1] for v in votes), "x": _features(kind, span, votes, before, close, after),
            })
    return base, found


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _propose(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([
        ("kind", pa.int32()), ("at", pa.int32()), ("until", pa.int32()), ("base", pa.bool_()),
        ("votes", pa.string()), ("x", pa.list_(pa.int32()))]))
    for batch in source:
        base, found = [], []
        for text in batch.column(1):
            b, f = proposals(text.as_py())
            base.append(said(b))
            found.append(f)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.string()), pa.array(found, kinds)], names=["doc_id", "base", "found"])


def reliabilities(counts: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of personal data, P(vote | truth) of each labeler, and P(true | votes) of each combination.

    ``counts`` has how often each combination of votes occurs.  The labelers are taken as
    independent given the truth; each starts, and is held by a few made-up votes, on the side
    of being better than chance.
    """
    names = sorted(counts)
    n = np.array([counts[v] for v in names], float)
    votes = np.array([["-0+".index(c) for c in v] for v in names])
    prior = np.array([[4.0, 3.0, 1.0], [1.0, 3.0, 4.0]])  # of - 0 + where false, where true
    true = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
    share, given = 0.5, np.empty((2, votes.shape[1], 3))
    for _ in range(rounds):
        both = np.stack([(1 - true) * n, true * n])
        share = (both[1].sum() + 1) / (n.sum() + 2)
        for j in range(votes.shape[1]):
            for y in range(2):
                given[y, j] = np.bincount(votes[:, j], both[y], 3) + prior[y]
        given /= given.sum(axis=2, keepdims=True)
        odds = np.log(share / (1 - share)) + sum(
            np.log(given[1, j, votes[:, j]] / given[0, j, votes[:, j]]) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - true).max() < 1e-9:
            break
        true = new
    return float(share), given, dict(zip(names, true.tolist()))


def fit(rows: list[tuple[list[int], float, float]], rounds: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier on (features, probability, weight)."""
    weight = np.zeros(FEATURES)
    if not rows:
        return weight
    owner = np.repeat(np.arange(len(rows)), [len(x) for x, _, _ in rows])
    flat = np.concatenate([np.asarray(x, np.int64) for x, _, _ in rows])
    truth, mass = (np.array([r[i] for r in rows], float) for i in (1, 2))
    mass /= mass.sum()
    moved = np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weight[flat], len(rows)), -30, 30)))
        slope = np.bincount(flat, ((guess - truth) * mass)[owner], FEATURES) + penalty * weight
        moved += slope * slope
        weight -= 0.5 * slope / np.sqrt(moved)
    return weight


def learn(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, from all votes and a bounded sample of different spans."""
    spans = found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.x")
    counts = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most 4 * 3^6 rows
    true = {}
    for kind in range(len(KINDS)):
        some = {r["votes"]: r["n"] for r in counts if r["kind"] == kind}
        if some:
            true[kind] = reliabilities(some)[2]
    rows = []
    for kind in true:
        different = spans.where(F.col("kind") == kind).groupBy("votes", "x").agg(F.count("*").alias("n"))
        picked = different.orderBy(F.xxhash64("votes", "x"), "votes", "x").limit(sample).collect()
        rows += [(r["x"], true[kind][r["votes"]], float(np.log1p(r["n"]))) for r in picked]
    return fit(rows)


def _decider(weight: np.ndarray, threshold: float):
    limit = np.log(threshold / (1 - threshold))

    def decide(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [(s["kind"], s["at"], s["until"]) for s in found if s["base"]]
                for kind, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(s[0] == kind for s in spans))
                out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                free, added = 0, 0
                for s in found:
                    if not s["base"] and s["at"] >= free and weight[s["x"]].sum() >= limit:
                        spans.append((s["kind"], s["at"], s["until"]))
                        free, added = s["until"], added + 1
                out["spans"].append(said(spans))
                out["n_added"].append(added)
            arrays = [pa.array(v, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *out])

    return decide


def personal_data(
    docs: DataFrame, text: str = "text", number: str = "doc_id", sample: int = SAMPLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    if not 0 < threshold < 1 or sample < 1:
        raise ValueError("the threshold is a probability, the sample at least 1")
    rows = docs.select(F.col(number).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = stored(rows.mapInArrow(_propose, _FOUND), "proposed")
    return found.mapInArrow(_decider(learn(found, sample), threshold), _OUT)

"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Wide patterns
propose further candidates of every sort: addresses written out, any number of five digits or more
with or without separators, national ids, bank accounts, values of secret names, and any token of 16
characters or more of which keys are made. Most of these are something else in an ordinary corpus:
order numbers, dates, versions, hashes, long words. Six labelers vote on each
candidate, base spans included, for (2), against (0), or abstain (1):

- shape: how strictly the span has its kind's form,
- gazetteer: lists of domain endings, number prefixes, reserved networks, lengths of hashes,
- context: cue words of the kind within a few words before the span,
- other things: cue words of orders, versions, commits and the like before it,
- surroundings: against spans that are part of a longer token,
- make-up: how the characters mix, against words, round numbers and runs.

Expectation-maximisation over the counts of candidate patterns (kind, votes, length and character classes) of all
documents estimates for each kind the share of personal data and how often each labeler votes for,
among personal data and among other things, and gives each pattern a probability. These train the
final span classifier, a logistic regression over the pattern's features, weighted by counts;
candidates that it scores 0.5 or more are added. Both tables have at most ``PATTERNS`` rows,
so they are small whatever the corpus.

Cases: null text counts as empty; repeated rows get equal spans; overlapping base spans of
different kinds all stay; an accepted span that overlaps a base span or an earlier accepted one is
left out; an empty table gives no rows; a corpus without candidates keeps base spans only; other
columns are ignored. Whole texts are read; every pattern takes time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

KINDS = ["email", "ip", "card", "phone", "secret", "account", "national_id", "iban"]
LABELERS, ITERATIONS = 6, 40
VOTES = 3**LABELERS
#: Base or not, kinds, three classes of length, three of characters, votes.
PATTERNS = 2 * len(KINDS) * 9 * VOTES
BASE = PATTERNS // 2

#: The base patterns. A look-behind keeps long digit runs linear; it doesn't change the matches.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Patterns of further candidates.
HIDDEN_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT) ?[\])}] ?[A-Za-z0-9-]+(?:(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?|\.)[A-Za-z0-9-]+)+")
SPOKEN_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ (?:at|AT) [A-Za-z0-9-]++(?:(?: (?:dot|DOT) |\.)[A-Za-z0-9-]++)+")
NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:\)?[ .-]?[0-9]){4,}(?![0-9A-Za-z])")
NATIONAL_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SECRET = re.compile(r"(?i:\b(token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key))\s*+(?:[:=]|is\b)\s*+[\"']?([A-Za-z0-9_/+-]{8,}={0,2})")
KEY = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}={0,2}")
DIGIT = re.compile(r"[0-9]")
#: Gazetteers.
ENDINGS = set("com org net edu gov info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at be se no dk fi pl pt".split())
CARD_PREFIXES = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|64|35|30|36|38|62")
NOT_HOSTS = re.compile(r"(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.")
#: Cue words, by kind, in English, French, German and Spanish.
CUES = {
    "email": "email e-mail mail contact write courriel correo kontakt schreiben",
    "ip": "ip address host server adresse dirección",
    "card": "card visa mastercard credit carte karte tarjeta",
    "phone": "phone tel call mobile fax téléphone telefon teléfono appelez anruf llame",
    "secret": "",
    "account": "account card number konto compte cuenta",
    "national_id": "ssn social security id",
    "iban": "iban account konto compte cuenta",
}
CUES = {k: set(v.split()) for k, v in CUES.items()}
AGAINST = set("version v page isbn issn doi section chapter figure table rev release order invoice item sku build commit hash sha md5 sha1 sha256 checksum etag ticket ref reference case tracking date model part lot serial bestellung commande pedido rechnung factura version".split())
SECRET_NAMES = set("token secret password passwd pwd key apikey credential credentials".split())
HASH = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})")
DATE = re.compile(r"(?:19|20)[0-9]{2}[ .-]?(?:0[1-9]|1[0-2])[ .-]?[0-3][0-9]|[0-3][0-9][ .-](?:0[1-9]|1[0-2])[ .-](?:19|20)[0-9]{2}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, found from the @ signs."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1, start):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, in the order of kinds and starts."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = _digits(m.group()) if 16 <= m.end() - m.start() <= 37 else ""
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def further_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(4, m.start(), m.end()) for m in KEY.finditer(text)]
    if "[" in text or "(" in text or "{" in text:
        out += [(0, m.start(), m.end()) for m in HIDDEN_EMAIL.finditer(text)]
    if " at " in text or " AT " in text:
        out += [(0, m.start(), m.end()) for m in SPOKEN_EMAIL.finditer(text)]
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            span, n = m.group(), len(_digits(m.group()))
            if span.count("(") != span.count(")"):
                continue
            kind = 6 if NATIONAL_ID.fullmatch(span) else 3 if 7 <= n <= 15 and (n == 10 or len(span) > n) else 5
            out.append((kind, m.start(), m.end()))
        out += [(7, m.start(), m.end()) for m in IBAN.finditer(text)]
    seen = {(s, e) for _, s, e in out}
    return out + [(4, m.start(2), m.end(2)) for m in SECRET.finditer(text) if m.span(2) not in seen]


def votes(text: str, kind: int, start: int, end: int) -> int:
    """The candidate's pattern: kind, classes of length and characters, and the labelers' votes as digits of base 3."""
    name, span = KINDS[kind], text[start:end]
    digits = _digits(span)
    n = len(digits)
    words = re.findall(r"[^\W_]+", text[max(0, start - 60) : start].lower())[-4:]
    letters = sum(map(str.isalpha, span))
    # changes between letters and digits, and between cases
    sorts = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "-" for c in span[:200])
    changes = sum(x != y for x, y in zip(sorts, sorts[1:], strict=False))
    plain = n and (len(set(digits)) <= 2 or digits.endswith("00000") or digits in "01234567890123456789" or digits in "98765432109876543210")
    mixed = 2 if n and letters and changes >= 4 else 0 if not n or not letters else 1
    if name == "email":
        host = span.rsplit("@", 1)[-1] if "@" in span else re.split(r"(?i)\bat\b", span, maxsplit=1)[-1]
        shape = 2 if "@" in span and len(span) <= 254 and ".." not in span else 2 if re.search(r"[\[({]", span) else 1 if re.search(r"(?i) dot ", span) else 0
        gazetteer = 2 if re.split(r"[^A-Za-z]+", host.rstrip(")]} "))[-1].lower() in ENDINGS else 1
        named = re.match(r"[A-Za-z0-9%+-]*[0-9._][A-Za-z0-9._%+-]*(?:@| ?[\[({ ])", span)
        makeup = 2 if named else 0 if shape == 0 else 1
    elif name == "ip":
        shape = 0 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 2
        gazetteer = 0 if NOT_HOSTS.match(span) else 1
        makeup = 0 if all(len(p) == 1 for p in span.split(".")) else 2 if sum(len(p) >= 2 for p in span.split(".")) >= 3 else 1
    elif name in ("card", "account"):
        shape = 2 if _luhn(digits) and n >= 13 else 0 if n < 12 else 1
        gazetteer = 2 if n >= 13 and CARD_PREFIXES.match(digits) else 0 if DATE.fullmatch(span) or n < 8 else 1
        makeup = 0 if plain or n < 10 else 2 if n in (15, 16, 19) else 1
    elif name == "phone":
        shape = 2 if span[0] in "+(" or re.fullmatch(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}", span) else 0 if re.search(r"(?<![0-9])[0-9](?![0-9])", span.lstrip("+")) else 1
        gazetteer = 2 if span[0] == "+" and digits[0] != "0" else 0 if DATE.fullmatch(span) or 978 <= int(digits[:3]) <= 979 and n == 13 else 1
        makeup = 0 if plain or n < 8 else 2 if 9 <= n <= 12 else 1
    elif name == "secret":
        kinds = sum(bool(re.search(p, span)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[_/+=-]"))
        shape = 2 if len(span) >= 16 and kinds >= 2 and n else 0 if kinds < 2 or not n else 1
        gazetteer = 0 if HASH.fullmatch(span) else 2 if len(set(span)) >= 12 and kinds >= 3 else 1
        makeup = mixed
    elif name == "national_id":
        shape = 0 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 2
        gazetteer = 1
        makeup = 0 if plain else 1
    else:
        moved = "".join(str(int(c, 36)) for c in (span[4:] + span[:4]).replace(" ", "") if c.isalnum())
        shape = 2 if int(moved) % 97 == 1 else 0
        gazetteer = 1
        makeup = 0 if plain else 1
    if name == "secret":  # hard to tell from other keys without a name
        context = 2 if SECRET_NAMES & set(words[-2:]) else 0
    else:
        context = 2 if CUES[name] & set(words) else 1
    other = 0 if AGAINST & set(words[-2:]) else 1
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    glued = left.isalnum() or right.isalnum() or left in ("-", "/", "_", ".", "#", "=") and bool(left) and name != "secret" or right in ("/", "_") and bool(right)
    size = 0 if len(span) < 8 else 1 if len(span) < 16 else 2
    sort = 0 if not letters else 1 if not n else 2
    return ((kind * 3 + size) * 3 + sort) * VOTES + ((((shape * 3 + gazetteer) * 3 + context) * 3 + other) * 3 + (0 if glued else 1)) * 3 + makeup


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and more: arrays of (kind, start, end, pattern) of each row; more may overlap."""
    span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())]
    of_span = pa.list_(pa.struct(span))

    def listed(text: str, spans: list[tuple[int, int, int]], base: int = 0) -> list[dict]:
        return [{"kind": k, "start": s, "end": e, "pattern": base + votes(text, k, s, e)} for k, s, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text)
                base.append(listed(text, own, BASE))
                more.append(listed(text, _beside(sorted(further_spans(text), key=lambda x: (x[1], x[0])), own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, of_span), pa.array(more, of_span)], names=["doc_id", "base", "more"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:int,start:int,end:int,pattern:int>>"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, base {spans}, more {spans}")


def _beside(spans: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the spans that overlap none of taken."""
    merged: list[list[int]] = []
    for _, s, e in sorted(taken, key=lambda x: x[1]):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts = [s for s, _ in merged]

    def free(s: int, e: int) -> bool:
        at = bisect_left(starts, e)  # the last one that starts before the end reaches farthest
        return not at or merged[at - 1][1] <= s

    return [(k, s, e) for k, s, e in spans if free(s, e)]


def estimate(patterns: np.ndarray, counts: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Probability that a candidate of each pattern is personal data, by EM over the labelers' votes for, by kind, among personal data and other things.

    Base spans are known: they tell how labelers vote on personal data, but not which share of the other candidates it is.
    """
    base, patterns = patterns >= BASE, patterns % BASE
    v = np.stack([patterns % VOTES // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)], 1) - 1
    kind = np.eye(len(KINDS))[patterns // (9 * VOTES)]
    p = np.where(base, 1.0, 1 / (1 + np.exp(-v.sum(1).astype(float))))
    open_ = np.where(base, 0.0, counts)
    for _ in range(iterations):
        share = ((kind * (open_ * p)[:, None]).sum(0) + 2) / ((kind * open_[:, None]).sum(0) + 4)
        logit = np.log(share / (1 - share)) @ kind.T
        rates = []
        for q, start in ((p, 0.8), (1 - p, 0.3)):  # ten made-up votes over all kinds, ten more of each kind
            w = (counts * q)[:, None]
            all_for = (10 * start + (w * (v > 0)).sum(0)) / (10 + (w * (v != 0)).sum(0))
            rates.append((10 * all_for + kind.T @ (w * (v > 0))) / (10 + kind.T @ (w * (v != 0))))
        yes, no = (np.clip(r, 0.005, 0.995) for r in rates)
        # a vote for never speaks against, nor a vote against for
        more, less = np.maximum(np.log(yes / no), 0), np.minimum(np.log((1 - yes) / (1 - no)), 0)
        logit = logit + ((v > 0) * (kind @ more)).sum(1) + ((v < 0) * (kind @ less)).sum(1)
        p = np.where(base, 1.0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    return p


def train(patterns: np.ndarray, p: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Scores of the span classifier for each pattern: logistic regression on kind, votes of each kind, length and characters, fitted to p."""
    patterns = patterns % BASE
    v = np.stack([patterns % VOTES // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)], 1)
    kind = np.eye(len(KINDS))[patterns // (9 * VOTES)]
    said = np.concatenate([np.eye(3)[v[:, j]] for j in range(LABELERS)], 1)
    of_kind = (kind[:, :, None] * said[:, None, :]).reshape(len(v), -1)
    x = np.concatenate([kind, said, of_kind, np.eye(3)[patterns // (3 * VOTES) % 3], np.eye(3)[patterns // VOTES % 3]], 1)
    weight = np.log1p(counts) / np.log1p(counts).sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-x @ w))
        h = (x * (weight * (q * (1 - q) + 1e-3))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (q - p)) + 1e-3 * w)
    return 1 / (1 + np.exp(-x @ w))


def accepted_patterns(found: DataFrame) -> set[int]:
    """Patterns that the classifier scores 0.5 or more."""
    counted = found.select(F.explode(F.concat("base", "more")).alias("c")).groupBy("c.pattern").agg(F.count("*").alias("n")).orderBy("pattern")
    rows = counted.limit(PATTERNS).collect()  # all there can be
    if not rows:
        return set()
    patterns, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    return set(patterns[train(patterns, estimate(patterns, counts), counts) >= 0.5].tolist())


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans, n_rejected of each row."""
    found = Scratch(spark).save(candidates(docs), "candidates")
    accepted = accepted_patterns(found)
    schema = pa.schema([*[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64()), ("n_rejected", pa.int64())])

    def text_of(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = [(x["kind"], x["start"], x["end"]) for x in base]
                every, last = list(own), 0
                for x in more:
                    if x["pattern"] in accepted and x["start"] >= last:
                        every.append((x["kind"], x["start"], x["end"]))
                        last = x["end"]
                row = [sum(k == j for k, _, _ in own) for j in range(4)]
                row += [hashlib.sha256(text_of(own).encode()).hexdigest(), text_of(every), len(every), sum(x["pattern"] not in accepted for x in more)]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out, schema, strict=True))], names=["doc_id", *schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS[:4]) + ", base_sha256 string, spans string, n_spans long, n_rejected long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))

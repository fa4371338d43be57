"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

1. Candidates of each text: the base spans (fixed patterns, which always stay), and looser ones: pieces of runs that a
   base pattern took too much of, national numbers, written-out addresses, account numbers, persons after a title or cue.
2. Labelers vote +1, 0 or -1 on each candidate: the strict shape (regex), its checksum or range, gazetteers (issuers,
   calling codes, endings, countries, given names), the words before and after it, what it is glued to (against only),
   other candidates near it (for only), and digits without variety (against only).
3. How often each pattern of votes occurs is counted over all documents. There are at most ``PATTERNS`` patterns, so the
   counts fit anywhere; expectation-maximisation over them gives each labeler's reliability for each kind and each
   pattern's probability, by which a logistic classifier of kind, votes, length and digits is trained. A failed checksum
   or range is final, as it is for base patterns: such candidates are the known false ones.
4. Candidates beside the base spans become spans where the classifier gives at least ``ACCEPT``.

Each text is read once: candidates with their patterns are written to the shared folder and judged from there.

Reliabilities have priors that are a share of a kind's candidates (and ``LEAST`` more, for kinds that hardly occur), so
they behave alike at every size; a labeler is taken to be better than chance, which tells the two classes apart.

Edge cases: null and empty texts have no spans; null ids are kept; texts of any length are searched whole, each pattern
in time linear in the text; repeated rows count and come out as often as they occur; without candidates nothing is
learnt and nothing added; an empty table gives an empty one; further columns are kept by ``scrub`` and ignored by ``scan``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, discard, map_batches, short_batches, table, written

KINDS = ("email", "ip", "card", "phone", "iban", "person")
LABELERS = ("shape", "valid", "gazetteer", "before", "after", "border", "company", "variety")
LENGTHS, DIGITS = 4, 3  #: steps of a candidate's length and of its share of digits
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * LENGTHS * DIGITS
ACCEPT = 0.9  #: least probability of a span that no base pattern gives
STRENGTH, LEAST = 0.05, 4  #: weight of the priors: a share of a kind's candidates, and as many more
NEAR, BEFORE, AFTER = 60, 40, 25  #: characters in which company and cues are looked for

# The base patterns. Those that begin with a run of digits begin only where one does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Looser ones.
_PIECE = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{3,4}){2}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9+)-])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])")
_WRITTEN = re.compile(r"([A-Za-z0-9._%+-]{1,64})\s?[(\[{]\s?at\s?[)\]}]\s?([A-Za-z0-9-]{1,63}(?:\s?[(\[{]\s?dot\s?[)\]}]\s?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,8})", re.IGNORECASE)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PERSON = re.compile(r"(?:(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof)\. ?|\b(?:[Mm]y name is|[Nn]ame:) )((?:[A-Z][a-z]{1,20}|[A-Z]\.)(?: (?:[A-Z][a-z]{1,20}|[A-Z]\.)){0,3})")
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}"), "ip": re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"), "person": re.compile(r"[A-Z][a-z]+(?: [A-Z]\.)?(?: [A-Z][a-z]+)+"),
}

# Gazetteers.
ENDINGS = frozenset("com org net edu gov int info io de fr es uk eu us in ca au nl it ch at be se no pl br jp cn ru".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|62|30|36|38")
CALLING = re.compile(r"\+?(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
IBANS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25, "IE": 22, "PL": 28, "SE": 24, "DK": 18, "FI": 18, "NO": 15}
GIVEN = frozenset("james john robert michael david william richard thomas mary patricia jennifer linda elizabeth barbara susan anna maria peter paul hans klaus pierre jean marie sophie carlos jose juan lucia carmen priya raj".split())
CUES = {
    "email": frozenset("email mail e-mail contact write reach courriel correo".split()), "ip": frozenset("ip server host address addr client".split()),
    "card": frozenset("card visa mastercard amex credit debit tarjeta carte karte kreditkarte".split()), "phone": frozenset("phone tel telephone call mobile cell fax telefon teléfono téléphone".split()),
    "iban": frozenset("iban account bank transfer konto cuenta compte".split()), "person": frozenset("name contact signed regards author patient".split()),
}
AGAINST = frozenset("version release order invoice isbn issn sku serial token key id ref build commit section chapter figure".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest local part before it, which reaches back to the last match at most."""
    until, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > until and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            until = m.end()
        at = text.find("@", max(until, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m[0])]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() < 40 and 12 <= len(d := _plain(m[0])) <= 19 and luhn(d)]
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdecimal, m[0])) <= 15] if "+" in text else []
    return sorted(found)


_DIGIT = re.compile("[0-9]")


def _plain(s: str) -> str:
    return s.replace(" ", "").replace("-", "")


def _cards(m: re.Match) -> Iterator[tuple[int, int]]:
    """Groups of digits in a run that is no card itself: one long enough, or four, six and five."""
    groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m[0])]
    for i, (a, b) in enumerate(groups):
        if 13 <= b - a <= 19:
            yield a, b
        sizes = tuple(y - x for x, y in groups[i : i + 4])
        if sizes == (4, 4, 4, 4):
            yield a, groups[i + 3][1]
        if sizes[:3] in ((4, 6, 5), (4, 6, 4)):
            yield a, groups[i + 2][1]


def looser(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beside the base spans, none over a base span of its own kind, by start, then kind; none over another."""
    taken = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
    found = []
    if _DIGIT.search(text):
        for m in CARD.finditer(text):
            if m.end() - m.start() > 12 and (m.start(), m.end()) not in taken[2]:
                found += [(a, 2, b) for a, b in _cards(m)]
        if "+" in text:
            at = text.find("+")
            while at >= 0:
                m = _PIECE.match(text, at)
                if m:
                    found.append((at, 3, m.end()))
                at = text.find("+", at + 1)
        found += [(m.start(), 3, m.end()) for m in _NATIONAL.finditer(text)]
        found += [(m.start(), 4, m.end()) for m in _IBAN.finditer(text)]
    if _AT.search(text):
        found += [(m.start(), 0, m.end()) for m in _WRITTEN.finditer(text)]
    if _TITLE.search(text):
        found += [(m.start(1), 5, m.end(1)) for m in _PERSON.finditer(text)]
    out, until = [], [0] * len(KINDS)
    nth = [0] * len(KINDS)
    for a, kind, b in sorted(found):
        own = taken[kind]
        while nth[kind] < len(own) and own[nth[kind]][1] <= a:
            nth[kind] += 1
        if a >= until[kind] and (nth[kind] == len(own) or own[nth[kind]][0] >= b):
            out.append((a, kind, b))
            until[kind] = b
    return out


_AT = re.compile(r"[(\[{]\s?at\s?[)\]}]", re.IGNORECASE)
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.|ame(?: is|:) ")
_WORD = re.compile(r"[^\W\d_][\w-]*")


def votes(text: str, a: int, kind: int, b: int, company: bool) -> tuple[int, ...]:
    """Each labeler's vote on a candidate, in the order of ``LABELERS``."""
    name, s = KINDS[kind], text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    shape = 1 if _SHAPES[name].fullmatch(s) else -1
    valid = gazetteer = 0
    if name == "card":
        valid, gazetteer = (1 if 12 <= len(digits) <= 19 and luhn(digits) else -1), (1 if ISSUERS.match(digits) else -1)
    elif name == "iban":
        plain = s.replace(" ", "")
        valid, gazetteer = (1 if mod97(plain) else -1), (1 if IBANS.get(plain[:2]) == len(plain) else -1)
    elif name == "ip":
        first = int(s.split(".")[0][-3:])
        valid, gazetteer = (1 if octets(s) else -1), (-1 if first in (0, 127) or first >= 224 else 1)
    elif name == "phone":
        valid, gazetteer = (1 if 9 <= len(digits) <= 15 else -1), (1 if s[0] == "+" and CALLING.match(s) else 0)
    elif name == "email":
        ending = re.split(r"[^A-Za-z0-9-]+", s.rstrip(")]}"))[-1].lower()
        valid, gazetteer = (1 if ending.isalpha() and len(ending) > 1 else -1), (1 if ending in ENDINGS else 0)
    else:
        gazetteer = 1 if s.split(" ")[0].lower() in GIVEN else 0
    cued = lambda part: (lambda w: 1 if w & CUES[name] else -1 if w & AGAINST else 0)({x.lower() for x in _WORD.findall(part)})
    glued = a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_=\"'/") or b < len(text) and (text[b].isalnum() or text[b] in "_=\"'/")
    flat = len(digits) > 8 and len(set(digits)) <= 2
    return shape, valid, gazetteer, cued(text[max(0, a - BEFORE) : a]), cued(text[b : b + AFTER]), -int(glued), int(company), -int(flat)


def code_of(kind: int, v: tuple[int, ...], length: int, digits: int) -> int:
    """A candidate's pattern as a number."""
    code = kind
    for x in v:
        code = code * 3 + x + 1
    return (code * LENGTHS + length) * DIGITS + digits


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (a column a labeler), steps of length and of digits of the patterns."""
    codes, digits = np.divmod(codes, DIGITS)
    codes, length = np.divmod(codes, LENGTHS)
    v = np.empty((len(codes), len(LABELERS)), np.int64)
    for i in reversed(range(len(LABELERS))):
        codes, v[:, i] = np.divmod(codes, 3)
    return codes, v - 1, length, digits


def candidates(text: str | None) -> list[tuple[int, int, int, bool, int]]:
    """(start, kind, end, base, pattern) of a text, by start, then kind; base spans before others."""
    if not text:
        return []
    base = base_spans(text)
    every = sorted([(a, k, b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in looser(text, base)], key=lambda x: (x[0], x[1], not x[3]))
    out, reach, behind = [], -NEAR - 1, [a for a, *_ in every] + [math.inf]
    for i, (a, kind, b, is_base) in enumerate(every):
        company = a - reach <= NEAR or behind[i + 1] - b <= NEAR
        reach = max(reach, b)
        digits = sum("0" <= c <= "9" for c in text[a:b])
        out.append((a, kind, b, is_base, code_of(kind, votes(text, a, kind, b, company), min(3, (b - a) // 10), min(2, 3 * digits // (b - a)))))
    return out


@dataclass
class Model:
    """``coef`` of the span classifier; ``reliability`` of each kind's labelers: how often a vote, if one is cast, is right."""

    coef: np.ndarray | None = None
    reliability: dict[tuple[str, str], float] | None = None

    def probability(self, codes: np.ndarray) -> np.ndarray:
        if self.coef is None:
            return np.zeros(len(codes))
        return np.where(_refuted(codes), 0.0, 1 / (1 + np.exp(-np.clip(_features(codes) @ self.coef, -30, 30))))


def _refuted(codes: np.ndarray) -> np.ndarray:
    return decode(codes)[1][:, LABELERS.index("valid")] == -1


def _features(codes: np.ndarray) -> np.ndarray:
    kind, v, length, digits = decode(codes)
    one = lambda x, n: np.eye(n)[x]
    return np.column_stack([np.ones(len(codes)), one(kind, len(KINDS)), (v == 1).astype(float), (v == -1).astype(float), one(length, LENGTHS), one(digits, DIGITS)])


def expect(codes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over patterns that occur ``n`` times: (probability of each, share of true ones by kind,
    P(vote | class) of each kind's labelers as [class, kind, labeler, vote + 1])."""
    kind, v, *_ = decode(codes)
    of = np.eye(len(KINDS))[kind]  # pattern, kind
    total = of.T @ n
    prior = np.empty((2, 1, len(LABELERS), 3))
    prior[1], prior[0] = (0.1, 0.2, 0.7), (0.7, 0.2, 0.1)
    weight = (STRENGTH * total + LEAST)[None, :, None, None]
    hits = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeler, vote
    known = ~_refuted(codes)
    p = ((v.sum(axis=1) > 0) * 0.8 + 0.1) * known
    for _ in range(rounds):
        before = p
        share = (of.T @ (n * p) + 1) / (total + 2)
        table = np.stack([np.einsum("c,ck,clv->klv", n * q, of, hits) for q in (1 - p, p)]) + weight * prior
        table /= table.sum(axis=3, keepdims=True)
        odds = np.einsum("clv,ck,klv->c", hits, of, np.log(table[1]) - np.log(table[0])) + of @ (np.log(share) - np.log(1 - share))
        p = known / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(p - before).max() < 1e-9:
            break
    return p, share, table


def _classifier(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic coefficients by Newton's method; a row counts n * p times as true and n * (1 - p) as false."""
    w, b = n / n.sum(), np.zeros(x.shape[1])
    r = ridge * np.eye(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ x + r, x.T @ (w * (p - q)) - r @ b)
        b += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return b


def learn(counts: list[tuple[int, int]]) -> Model:
    """The model of pattern counts: (pattern, candidates)."""
    if not counts:
        return Model()
    codes, n = (np.array(x, np.int64) for x in zip(*sorted(counts), strict=True))
    p, _, table = expect(codes, n.astype(float))
    coef = _classifier(_features(codes), p, np.sqrt(n.astype(float)))  # by the root of its count, a rare pattern has its say
    right = (table[1, ..., 2] / (table[1, ..., 2] + table[0, ..., 2]) + table[0, ..., 0] / (table[0, ..., 0] + table[1, ..., 0])) / 2
    return Model(coef, {(k, name): float(right[i, j]) for i, k in enumerate(KINDS) for j, name in enumerate(LABELERS)})


_FOUND = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,pattern:bigint>>"


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): each text's candidates."""
    short_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int64())]))
    names = ("start", "kind", "end", "base", "pattern")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch(**{id_col: b.column(0), "found": pa.array([[dict(zip(names, c, strict=True)) for c in candidates(t)] for t in b.column(1).to_pylist()], kind)})

    return map_batches(docs.select(id_col, text_col), f, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, found {_FOUND}")


def fit(seen: DataFrame) -> Model:
    """Learns from the candidates of all documents; what reaches the driver are counts of at most ``PATTERNS`` patterns."""
    counts = seen.select(F.explode("found").alias("c")).groupBy("c.pattern").count()
    return learn([tuple(r) for r in counts.collect()])


def judged(seen: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``seen`` with ``found`` as [{start, kind, end, base, score}]: base spans and accepted ones, by start, then kind."""
    at = seen.columns.index("found")
    to = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        every = b.column(at).to_pylist()
        codes = np.array(sorted({c["pattern"] for x in every for c in x}), np.int64)
        p = dict(zip(codes.tolist(), model.probability(codes).tolist(), strict=True))
        kept = [[{"start": c["start"], "kind": KINDS[c["kind"]], "end": c["end"], "base": c["base"], "score": p[c["pattern"]]} for c in x if c["base"] or p[c["pattern"]] >= accept] for x in every]
        return pa.RecordBatch.from_arrays([pa.array(kept, to) if i == at else col for i, col in enumerate(b.columns)], names=b.schema.names)

    schema = ", ".join(f"`{n}` {t}" if n != "found" else "found array<struct<start:bigint,kind:string,end:bigint,base:boolean,score:double>>" for n, t in seen.dtypes)
    return map_batches(seen, f, schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(id, found): the spans of each text, learnt from all of them. Offsets are code points, ends exclusive."""
    seen = written(found(docs, id_col, text_col), "candidates")
    out = written(judged(seen, fit(seen), accept), "pii")
    discard(seen)
    return out


def scrub(docs: DataFrame, model: Model, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """All rows and columns; in the texts, each run of overlapping spans is replaced by its first one's kind in brackets."""
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        every = candidates(text)
        if not every:
            return text
        p = model.probability(np.array([c[4] for c in every], np.int64))
        out, until = [], 0
        for (a, kind, b, base, _), q in zip(every, p, strict=True):
            if base or q >= accept:
                if a >= until:
                    out += [text[until:a], f"[{KINDS[kind].upper()}]"]
                until = max(until, b)
        return "".join(out) + text[until:]

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.column(at).type))

    return map_batches(docs, f, docs.schema)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["base"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *map(n, KINDS[:4]), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: ~s["base"])).cast("long").alias("n_added"))

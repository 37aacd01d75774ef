"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier decides.

Patterns propose spans: strict ones, which are always personal data, and loose ones.  Labelers look at a span's
pattern, its check digits, its layout, lists of known names and numbers, and the words around it; each votes for,
against, or not at all.  Expectation-maximisation over the counts of all vote patterns estimates how often each
labeler is right on spans of each kind.  A logistic classifier of hashed features of the span and of its
surroundings is then fitted to the estimated probabilities, and decides on the loose spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import small_batches, written

#: Kinds in the order in which they are listed; the first four have strict patterns.
KINDS = ("email", "ip", "card", "phone", "ident", "name")
EMAIL, IP, CARD, PHONE, IDENT, NAME = range(6)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits, dotted or not, so that none is read twice; addresses are their parts in fours from the left.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: The gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov info biz io de fr es it uk eu ch at nl be pl pt br mx ar us ca au jp cn in ru se no dk fi".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
GIVEN_NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Paul Emily Peter Anna Hans Ursula "
    "Wolfgang Sabine Klaus Monika Stefan Petra Andreas Claudia José María Juan Carmen Antonio Ana Francisco Isabel Luis Pilar Carlos Lucía Jean Marie Pierre Jeanne Michel Françoise Philippe Monique Nicolas Nathalie".split()
)
IBAN_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split())
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame"
_CAPITAL = "[A-ZÄÖÜÉÁ][a-zäöüßéáíóúñ]{1,30}"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s)"
_USER, _LABEL = "[A-Za-z0-9._%+-]{1,64}", "[A-Za-z0-9-]{1,63}"
#: Loose patterns: kind, what a text must have at all, the pattern, and the characters that can't stand before a match.
#: All repetitions are bounded, so that their work grows with the text.
LOOSE = tuple(
    (kind, re.compile(needs), re.compile(pattern), re.compile(before))
    for kind, needs, pattern, before in (
        (EMAIL, r"[\[({]\s?(?:at|@)", rf"{_USER}\s?[\[({{]\s?(?:at|@)\s?[\])}}]\s?{_LABEL}(?:{_DOT}{_LABEL}){{1,4}}", "[A-Za-z0-9._%+-]"),
        (EMAIL, " dot ", rf"{_USER} at {_LABEL}(?: dot {_LABEL}){{1,4}}", "[A-Za-z0-9._%+-]"),
        (IP, ":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:", "(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "[0-9A-Fa-f:]"),
        (CARD, "[0-9]{4}[./_]", r"[0-9]{4}(?:([./_])[0-9]{4})(?:\1[0-9]{4}){2}(?![0-9])", "[0-9.]"),
        (PHONE, "[0-9]{3}[ .-][0-9]{3}", r"(?:\([0-9]{2,4}\)\s?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", "[0-9+().-]"),
        (PHONE, "00[1-9][0-9]{8}", "00[1-9][0-9]{8,12}(?![0-9])", "[0-9+().-]"),
        (IDENT, "[0-9]-[0-9]{2}-[0-9]", "[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9-]"),
        (IDENT, "[0-9]{2} ?[A-Z0-9]{4}", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Za-z0-9]"),
        (NAME, f"(?:{_TITLES})[. ]", rf"(?:{_TITLES})\.? {_CAPITAL}(?: {_CAPITAL})?(?!\w)", r"\w"),
        (NAME, f"(?:{'|'.join(sorted(GIVEN_NAMES))}) [A-ZÄÖÜÉÁ]", rf"(?:{'|'.join(sorted(GIVEN_NAMES))}) {_CAPITAL}(?!\w)", r"\w"),
    )
)
_CUES = {
    EMAIL: "mail e-mail email contact write correo kontakt courriel",
    IP: "ip address host server login client adresse dirección",
    CARD: "card credit visa mastercard amex payment karte tarjeta carte",
    PHONE: "phone call tel telephone mobile fax cell contact telefon anruf teléfono llamar téléphone",
    IDENT: "ssn social security iban account konto cuenta compte",
    NAME: "name called signed dear sincerely herr frau señor señora monsieur madame mr mrs ms dr prof",
}
CUES = {kind: frozenset(words.split()) for kind, words in _CUES.items()}
COUNTER_CUES = frozenset("version release chapter section isbn issn invoice order figure fig table page pages no nr id sku serial total eur usd".split())

#: Characters around a span that labelers and features see; buckets of hashed features.
AROUND, BUCKETS = 40, 1 << 13
LABELERS = ("pattern", "check digits", "layout", "gazetteer", "cue words", "counter words", "numbers around", "document")
#: Check digits are arithmetic: they hold on nearly all real numbers and on one of ten others, so these rates of votes
#: (none, for, against), on what is not and what is personal data, are not estimated.
PATTERN, CHECK = 0, 1
CHECK_RATES = np.array([[0.5, 0.05, 0.45], [0.5, 0.4995, 0.0005]])
#: Distinct spans, in the mean, that the classifier is fitted on, and the probability from which a loose span counts.
SAMPLE_SPANS, ADD_AT = 20_000, 0.6
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at, low = 0, text.find("@"), 0
    while at >= 0:
        low = max(low, end)
        before = text[low:at]
        start = low + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        low = at + 1
        at = text.find("@", max(at + 1, end))


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans of the first four kinds by their strict patterns, in order of start and kind."""
    out = [(s, EMAIL, e) for s, e in _emails(text)]
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in four):
                out.append((at, IP, end))
            at = end + 1
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), CARD, m.end()))
    out += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _loose_spans(text: str, strict: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Proposals beside the strict spans: none meets a strict one."""
    taken = [(s, e) for s, _, e in strict]
    found = {(m.start(), kind, m.end()) for kind, needs, pattern, bad in LOOSE if needs.search(text) for m in pattern.finditer(text) if not m.start() or not bad.match(text, m.start() - 1)}
    found |= {(m.start(), CARD, m.end()) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() <= 37 and 13 <= len(_digits(m[0])) <= 19}
    starts, reach = np.array([s for s, _ in taken], np.int64), np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else None
    free = lambda s, e: not taken or (k := int(np.searchsorted(starts, e))) == 0 or reach[k - 1] <= s
    return sorted(x for x in found if free(x[0], x[2]))


def _votes(kind: int, value: str, strict: bool, before: str, after: str, others: tuple[bool, bool]) -> list[int]:
    """The vote of each labeler: 1 for, 2 against, 0 none."""
    digits, words = _digits(value), value.split()
    check = layout = known = 0
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z]+", value.rstrip("-"))[-1].lower()
        layout, known = 1 if len(last) >= 2 else 2, 1 if last in TOP_DOMAINS else 0
    elif kind == IP:
        layout = 2 if re.search(r"(?:^|\.)0[0-9]", value) else 1
        known = 2 if value.startswith(("0.", "1.0", "2.0", "127.0.0.1", "255.")) else 0
    elif kind == CARD:
        check, layout = 1 if _luhn(digits) else 2, 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}(?:[ ./_-][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", value) else 2
        known = 1 if digits[0] in "3456" else 2
    elif kind == PHONE:
        layout = 1 if re.fullmatch(r"(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|00[0-9]+", value) else 2
        known = 1 if value.startswith("+") and any(digits[:k] in CALLING_CODES for k in (1, 2)) or "555" in value else 0
    elif kind == IDENT and value[0].isdigit():
        check = 2 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 0
        layout = 1
    elif kind == IDENT:
        check, known = 1 if _iban(value) else 2, 1 if value[:2] in IBAN_COUNTRIES else 2
    else:
        layout = 1 if words[0].rstrip(".").lower() in CUES[NAME] else 0
        known = 1 if GIVEN_NAMES & set(words) else 0 if layout else 2
    near = {w.lower() for w in _WORD.findall(before)[-6:] + _WORD.findall(after)[:3]}
    cue = 1 if near & CUES[kind] or kind == NAME and layout else 0
    counter = 2 if near & COUNTER_CUES else 0
    beside = 2 if kind != NAME and re.search(r"[0-9][ .,:;/=*+-]{0,2}$", before) or kind != NAME and re.match(r"[ .,:;/=*+-]{0,2}[0-9]", after) else 0
    document = (1 if others[0] else 0) if not others[1] else 2
    return [1 if strict else 0, check, layout, known, cue, counter, beside, document]


def _features(kind: int, value: str, check: int, before: str, after: str) -> list[int]:
    """Hashed features of the span's layout, check digits, pieces and of the words around it; each kind has its own."""
    shape = re.sub(r"[A-ZÄÖÜÉÁ]", "A", re.sub(r"[a-zäöüßéáíóúñ]", "a", re.sub(r"[0-9]", "0", value)))
    short = re.sub(r"(.)\1+", r"\1", shape)
    got = ["bias", f"check {check}", f"shape {shape[:24]}", f"short {short[:24]}", f"length {len(value).bit_length()}", f"digits {min(20, len(_digits(value)))}", f"start {value[:1]}", f"left {before[-1:]}", f"right {after[:1]}"]
    got += [f"part {p.lower()}" for p in re.split(r"[^A-Za-z]+", value)[:6] if p]
    got += [f"before {w.lower()}" for w in _WORD.findall(before)[-4:]] + [f"after {w.lower()}" for w in _WORD.findall(after)[:2]]
    return sorted({zlib.crc32(f"{kind} {g}".encode()) % BUCKETS for g in got})


def _proposals(text: str) -> list[tuple[int, int, int, bool, list[int], list[int]]]:
    """(start, kind, end, strict, votes, features) of all spans of a text."""
    strict = strict_spans(text)
    loose = _loose_spans(text, strict)
    many = np.bincount([k for _, k, _ in strict + loose], minlength=len(KINDS))
    out = []
    for spans, firm in ((strict, True), (loose, False)):
        for start, kind, end in spans:
            before, after, value = text[max(0, start - AROUND) : start], text[end : end + AROUND], text[start:end]
            others = (len(strict) > firm, bool(many[kind] > 20))
            shown = value[:200]  # only strict spans can be longer; their place does not depend on it
            votes = _votes(kind, shown, firm, before, after, others)
            out.append((start, kind, end, firm, votes, _features(kind, shown, votes[CHECK], before, after)))
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(kind, sum(v * 3**j for j, v in enumerate(votes)), features) for t in batch.column(0) if t.is_valid for _, kind, _, _, votes, features in _proposals(t.as_py())]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.list_(pa.int32())), strict=True)], ["kind", "votes", "features"])


@dataclass
class Model:
    """Rates of votes (kind x labeler x [is not, is personal data] x vote), shares of the kinds, classifier weights."""

    rates: np.ndarray
    share: np.ndarray
    weights: np.ndarray


def _unvote(votes: np.ndarray) -> np.ndarray:
    return votes[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def posterior(kind: np.ndarray, votes: np.ndarray, rates: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The probability that spans with these votes are personal data; that of strict spans is 1.

    A vote can only speak for what it says, and no vote says nothing.
    """
    odds = np.log(share[kind] / (1 - share[kind]))
    for vote, bound in ((1, np.maximum), (2, np.minimum)):
        says = bound(0.0, np.log(rates[:, :, 1, vote] / rates[:, :, 0, vote]))
        odds += np.where(votes == vote, says[kind], 0.0).sum(axis=1)
    return np.where(votes[:, PATTERN] == 1, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def estimate(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(rates, share) by expectation-maximisation over vote patterns and their numbers.

    Strict spans are known to be personal data, so they tell how labelers vote on it; shares are those among loose
    spans.  It starts where four of five votes are right; ten such votes of each labeler stay in as a prior.
    """
    prior = np.array([[5.0, 1.0, 4.0], [5.0, 4.0, 1.0]])
    rates, share = np.tile(prior / 10, (len(KINDS), len(LABELERS), 1, 1)), np.full(len(KINDS), 0.5)
    rates[:, CHECK] = CHECK_RATES
    loose = votes[:, PATTERN] != 1
    for _ in range(rounds):
        p = posterior(kind, votes, rates, share)
        fresh = rates.copy()
        for k in range(len(KINDS)):
            own = kind == k
            weight = np.stack([(n * (1 - p))[own], (n * p)[own]])
            share[k] = ((n * p)[own & loose].sum() + 5) / (n[own & loose].sum() + 10)
            for vote in range(3):
                fresh[k, :, :, vote] = (prior[:, vote] + (weight @ (votes[own] == vote)).T) / (10 + weight.sum(axis=1))
        fresh[:, CHECK] = CHECK_RATES
        moved, rates = np.abs(fresh - rates).max(), fresh
        if moved < 1e-9:
            break
    return rates, share


def fit(features: list[list[int]], p: np.ndarray, n: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier of hashed features by full gradients, for target probabilities and row weights."""
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-12)
    if not features:
        return weights
    lengths = np.array([len(f) for f in features])
    flat, row = np.concatenate([np.array(f, np.int64) for f in features]), np.repeat(np.arange(len(features)), lengths)
    for _ in range(rounds):
        score = np.bincount(row, weights[flat], len(features))
        off = n * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - p)
        slope = np.bincount(flat, off[row], BUCKETS) / n.sum() + ridge * weights
        squares += slope**2
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Estimate the labelers' reliabilities from the votes on all spans of all texts, and fit the classifier.

    Vote patterns are at most 3**8 of each kind, so their counts are small however many spans there are.  The
    classifier sees SAMPLE_SPANS distinct (votes, features) in the mean, drawn by their hash and weighted by how
    often they occur; so neither row order nor repeated rows matter to which are drawn.  Null texts have no spans;
    without any span the model keeps its starting values and adds nothing.
    """
    small_batches(docs.sparkSession)
    spans = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_gathered, "kind int, votes int, features array<int>")
    distinct = written(spans.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "proposals")
    patterns = distinct.groupBy("kind", "votes").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).orderBy("kind", "votes").collect()
    kind, votes, n, rows = (np.array([r[c] for r in patterns], np.int64) for c in ("kind", "votes", "n", "rows"))
    rates, share = estimate(kind, _unvote(votes), n)
    keep = min(1.0, SAMPLE_SPANS / max(1, int(rows.sum())))
    drawn = distinct.where(F.pmod(F.xxhash64("kind", "votes", "features"), F.lit(1 << 30)) < F.lit(int(keep * (1 << 30))))
    sample = sorted((r["kind"], r["votes"], r["features"], r["n"]) for r in drawn.collect())
    kind, votes, n = (np.array([r[c] for r in sample], np.int64) for c in (0, 1, 3))
    weights = fit([r[2] for r in sample], posterior(kind, _unvote(votes), rates, share) if sample else np.zeros(0), np.sqrt(n))
    return Model(rates, share, weights)


def _decided(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(strict spans, spans added) of a text; of overlapping additions the likelier stays, then the earlier, then the longer."""
    strict, scored = [], []
    for start, kind, end, firm, _, features in _proposals(text):
        if firm:
            strict.append((start, kind, end))
        elif (p := 1 / (1 + np.exp(-np.clip(model.weights[features].sum(), -30, 30)))) >= ADD_AT:
            scored.append((-p, start, -end, kind))
    added: list[tuple[int, int, int]] = []  # in order of their start
    for _, start, end, kind in sorted(scored):
        at = bisect_left(added, (start,))
        if (at == 0 or added[at - 1][2] <= start) and (at == len(added) or added[at][0] >= -end):
            added.insert(at, (start, kind, -end))
    return strict, added


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _over(columns: list[tuple[str, pa.DataType]], use: Callable[[str | None], tuple]):
    """Each batch with its last column, the text, replaced by ``columns`` computed from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[use(t.as_py()) for t in batch.column(batch.num_columns - 1)], strict=True)) or [()] * len(columns)
            made = [pa.array(c, t) for c, (_, t) in zip(found, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *[n for n, _ in columns]])

    return run


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of ``docs``.

    Spans are ``kind:start:end`` in code points, the end exclusive, by start and then kind.  Strict spans always stay; a
    loose one is added if the classifier gives it ADD_AT or more, and never meets a strict or another added one.  A
    null text is empty; equal rows get equal results, and rows without id are rows like others.  Texts may be of any length:
    strict patterns read a text once, loose ones look at bounded pieces.
    """
    small_batches(docs.sparkSession)

    def digest(text: str | None) -> tuple:
        strict, added = _decided(text or "", model)
        counts = [sum(k == kind for _, k, _ in strict) for kind in range(4)]
        return (*counts, hashlib.sha256(_listed(strict).encode()).hexdigest(), _listed(strict + added), len(added))

    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
    columns = [(c, pa.string() if c in ("base_sha256", "spans") else pa.int64()) for c in names]
    schema = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in columns)
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_over(columns, digest), f"doc_id {id_type}, {schema}")


def redacted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in square brackets; null texts stay null.

    Where spans overlap, the first stands for all that it meets.
    """
    small_batches(docs.sparkSession)

    def replace(text: str | None) -> tuple:
        if text is None:
            return (None,)
        strict, added = _decided(text, model)
        out, at = [], 0
        for start, kind, end in sorted(strict + added):
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = max(at, end)
        return ("".join([*out, text[at:]]),)

    others = [c for c in docs.columns if c != text_col]
    ordered = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`"))
    schema = ordered.schema
    return ordered.mapInArrow(_over([(text_col, pa.string())], replace), schema).select(*[F.col(f"`{c}`") for c in docs.columns])

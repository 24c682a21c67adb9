"""Personal data by weak supervision (operator 7).

Base spans follow fixed patterns and always count. Beyond them, broad patterns propose candidates (also of
further kinds), and labelers vote on each: the strict pattern, a check of structure, a gazetteer, words
before the span, and signs of something else. Expectation-maximisation over the counts of all vote patterns
estimates every labeler's reliability per kind without any labels; its posteriors train the final span
classifier, for each kind a logistic regression over the votes and over features that no labeler sees: what the span is
made of, what stands on either side of it, how long it is, and how mixed its characters are. So it can turn down a span
whose votes look right, and take one that no labeler knows. Candidates it accepts join the base spans.

Texts are scanned once. What the driver gets is a count for each vote pattern, of which there is a fixed
number at most, and the most frequent patterns of votes and features, of which ``most_patterns`` are fitted on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewave.llm.common import slices
from linewave.storage import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "person", "secret", "social")
LABELERS = ("pattern", "structure", "gazetteer", "context", "contrary", "edges")

# A choice of names, countries and words for the gazetteer and context labelers; lengths of IBANs are fixed by their registry.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk it nl ch at be eu pl pt se us ca au jp cn br mx".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 60 61 62 63 65 66 81 82 86 90 91".split())
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
FIRST_NAMES = frozenset(
    "James John Robert Michael William David Richard Thomas Charles Daniel Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Anna Maria Peter Paul Hans Klaus "
    "Ursula Monika Petra Stefan Andreas Jean Pierre Michel Marie Jacques Claire Sophie Antonio Manuel Jose Carmen Isabel Juan Carlos Ana Lucia Pablo".split()
)
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|correo|kontakt|courriel|write to)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|adresse|login from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|debit|karte|carte|tarjeta|pay|cc)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|telefon|teléfono|téléphone|handy)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
    "person": re.compile(r"(?i)\b(?:name|signed|author|dear|regards)\b"),
    "secret": re.compile(r"(?i)(?:token|key|secret|password|passwd|pwd|bearer)"),
    "social": re.compile(r"(?i)\b(?:ssn|social security|social)\b"),
}
CONTRARY = re.compile(r"(?i)\b(?:version|release|section|chapter|isbn|issn|doi|invoice|order|figure|fig|build|page|sha|md5|commit|checksum)\b")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PROPOSALS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*+ ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]++(?:(?: ?[\[({] ?dot ?[\])}] ?|\.)[A-Za-z0-9-]++)++", re.IGNORECASE),
    "phone": re.compile(r"(?<![\w+.(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{3,4}[ .-][0-9]{3,5}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "person": re.compile(r"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? )?[A-Z][a-zà-öø-ÿ]++ [A-Z][a-zà-öø-ÿ]++(?!\w)"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"),
    "social": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
}
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\b")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their at signs.

    The run of local characters before an at sign belongs to no other at sign, so each character is looked
    at once, however long the text.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end), leftmost non-overlapping within a kind; failing matches are dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates (kind, start, end), none of which overlaps a base span; of two that overlap, the longer stays."""
    taken = sorted((a, b) for _, a, b in base)
    starts = np.asarray([a for a, _ in taken], dtype=np.int64)
    ends = np.maximum.accumulate(np.asarray([b for _, b in taken], dtype=np.int64)) if taken else starts
    out = []
    for kind, pattern in _PROPOSALS.items():
        for m in pattern.finditer(text):
            i = int(np.searchsorted(starts, m.end()))
            if i == 0 or ends[i - 1] <= m.start():
                out.append((kind, *m.span()))
    if len(out) < 2:
        return out
    kept: list[tuple[str, int, int]] = []
    for s in sorted(out, key=lambda s: (s[1], s[1] - s[2])):
        while kept and s[1] < kept[-1][2] and s[2] - s[1] > kept[-1][2] - kept[-1][1]:
            kept.pop()
        if not kept or s[1] >= kept[-1][2]:
            kept.append(s)
    return sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1]))


def _structure(kind: str, span: str) -> int:
    digits = re.sub(r"\D", "", span)
    if kind == "card":
        return int(luhn(digits) and len(set(digits)) > 2)
    if kind == "iban":
        plain = span.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return int(int(number) % 97 == 1 and IBAN_LENGTHS.get(plain[:2], len(plain)) == len(plain))
    if kind == "phone":
        return int(8 <= len(digits) <= 15 and len(set(digits)) > 2)
    if kind == "ip":
        return int(span not in ("0.0.0.0", "1.2.3.4", "255.255.255.255"))
    if kind == "social":
        return int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    if kind == "secret":
        kinds = sum(bool(re.search(p, span)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        return int(len(set(span)) >= 10 and kinds >= 2)
    return -1


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return int(re.split(r"[\W_]+", span)[-1].lower() in TOP_DOMAINS)
    if kind == "phone" and span[0] == "+":
        head = re.sub(r"\D", "", span)[:3]
        return int(any(head[:n] in COUNTRY_CODES for n in (1, 2, 3)))
    if kind == "iban":
        return int(span[:2] in IBAN_LENGTHS)
    if kind == "person":
        return int(any(w in FIRST_NAMES for w in span.split()[:2]))
    return -1


def _gazetted(names: frozenset[str]):
    return lambda kind, span: _gazetteer(kind, span) if kind != "person" else int(any(w in names for w in span.split()[:3]))


def votes(text: str, kind: str, start: int, end: int, is_base: bool, names: frozenset[str] = FIRST_NAMES) -> str:
    """The labelers' votes on a span, one character each: 1 personal, 0 not, - none; then its length class."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    title = kind == "person" and _TITLE.match(span)
    got = (
        1 if is_base else (1 if title else -1),
        _structure(kind, span),
        _gazetted(names)(kind, span),
        1 if CONTEXT[kind].search(before) else (0 if kind in ("secret", "person") and not title else -1),
        0 if CONTRARY.search(before) else -1,
        0 if (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()) and start else -1,
    )
    return "".join("-01"[v + 1] for v in got) + str(min(9, (end - start).bit_length()))


def features(text: str, start: int, end: int) -> str:
    """What no labeler sees of a span, a character each: the sign before it, the sign after it, what it is made of, its variety.

    Signs: n none or line break, s space, q quote or bracket, c colon or equals, p other punctuation, w word character.
    Made of: d digits, h hexadecimal digits, l letters, m letters and digits, x these and other signs, y digits and other signs.
    Variety: different characters by length, in tenths below 10.
    """
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    if before == " ":
        before = text[max(0, start - 2) : start - 1].strip() and text[start - 2] in ":=" and text[start - 2] or " "
    span = text[start:end]
    digits, letters = sum(map(str.isdigit, span)), sum(map(str.isalpha, span))
    if digits == len(span):
        made = "d"
    elif digits + letters == len(span):
        made = "l" if not digits else ("h" if set(span.lower()) <= _HEX and len({*filter(str.isalpha, span)} & {*filter(str.isupper, span)}) in (0, len({*filter(str.isalpha, span)})) else "m")
    else:
        made = "x" if letters else "y"
    return _sign(before) + _sign(after) + made + str(min(9, 10 * len(set(span)) // max(1, len(span))))


_HEX = frozenset("0123456789abcdef")
SIGNS, MADE = "nsqcpw", "dhlmxy"


def _sign(c: str) -> str:
    if not c or c in "\r\n":
        return "n"
    if c.isspace():
        return "s"
    if c in "\"'`()[]{}<>«»“”„":
        return "q"
    if c in ":=":
        return "c"
    return "w" if c.isalnum() else "p"


def reliabilities(patterns: list[tuple[str, str]], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each (kind, votes) pattern and (kinds, labelers, 2) estimated chances by class that a vote cast is 1.

    Each kind has a mixture of two classes in which labelers vote 1, 0 or not at all, independently; that a labeler has
    nothing to say can tell the classes apart too. Pseudo-counts of 8 right and 2 wrong votes and 10 missing ones a class,
    beside 1,000 spans of each kind or more (fewer weigh as many), keep the classes' meaning.
    """
    kind = np.asarray([KINDS.index(k) for k, _ in patterns], dtype=np.int64)
    counts = counts * np.maximum(1, 1000 / np.maximum(np.bincount(kind, counts, len(KINDS)), 1e-9))[kind]
    vote = np.asarray(["-01".index(c) for _, v in patterns for c in v[: len(LABELERS)]]).reshape(-1, len(LABELERS))
    start = np.asarray([[10.0, 8, 2], [10, 2, 8]])  # of class 0 and 1: none, 0, 1
    chance = np.tile(start / start.sum(axis=1, keepdims=True), (len(KINDS), len(LABELERS), 1, 1))
    prior, post = np.full(len(KINDS), 0.5), np.full(len(patterns), 0.5)
    each = np.arange(len(LABELERS))
    for _ in range(rounds):
        by_class = np.log(chance[kind[:, None], each, :, vote]).sum(axis=1)
        odds = by_class[:, 1] - by_class[:, 0] + np.log(prior[kind] / (1 - prior[kind]))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for c, w in enumerate(((1 - post) * counts, post * counts)):
            seen = np.tile(start[c], (len(KINDS), len(LABELERS), 1))
            np.add.at(seen, (kind[:, None], each, vote), w[:, None])
            chance[:, :, c] = seen / seen.sum(axis=2, keepdims=True)
        total = np.bincount(kind, counts, len(KINDS))
        prior = (np.bincount(kind, post * counts, len(KINDS)) + 1) / (total + 2)
    return post, chance[..., 2] / (chance[..., 1] + chance[..., 2])


#: Columns of a design row: 1, two a labeler, lengths, signs before and after, what it is made of, variety.
_WIDTHS = (1, 2 * len(LABELERS), 10, len(SIGNS), len(SIGNS), len(MADE), 10)
_AT = np.cumsum((0, *_WIDTHS))


def _design(patterns: list[tuple[str, str]]) -> np.ndarray:
    """A row for each (kind, votes and length[, features])."""
    x = np.zeros((len(patterns), int(_AT[-1])))
    for i, (_, v) in enumerate(patterns):
        x[i, 0] = 1
        for j, c in enumerate(v[: len(LABELERS)]):
            if c != "-":
                x[i, _AT[1] + 2 * j + int(c)] = 1
        x[i, _AT[2] + int(v[len(LABELERS)])] = 1
        if more := v[len(LABELERS) + 1 :]:
            for at, place in zip(_AT[3:], (SIGNS.index(more[0]), SIGNS.index(more[1]), MADE.index(more[2]), int(more[3]))):
                x[i, at + place] = 1
    return x


def span_classifier(patterns: list[tuple[str, str]], counts: np.ndarray, post: np.ndarray, steps: int = 30, ridge: float = 1.0, kind_weight: float = 1000.0) -> np.ndarray:
    """(kinds, columns) weights of logistic regressions, one a kind, fitted to the posteriors by Newton steps.

    A pattern weighs by its share of its kind's spans, ``kind_weight`` for a whole kind, so a larger table of the
    same make gives the same weights.
    """
    every, kind = _design(patterns), np.asarray([KINDS.index(k) for k, _ in patterns], dtype=np.int64)
    out = np.zeros((len(KINDS), every.shape[1]))
    for k in np.unique(kind):
        own = kind == k
        x, goal, w = every[own], post[own], out[k]
        weight = kind_weight * counts[own] / counts[own].sum()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            grad = x.T @ (weight * (p - goal)) + ridge * w
            w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w)), grad)
    return out


def span_scores(patterns: list[tuple[str, str]], weights: np.ndarray) -> np.ndarray:
    """Probability that a span of each (kind, votes, length and features) is personal data."""
    if not patterns:
        return np.zeros(0)
    kind = np.asarray([KINDS.index(k) for k, _ in patterns], dtype=np.int64)
    return 1 / (1 + np.exp(-np.clip((_design(patterns) * weights[kind]).sum(axis=1), -50, 50)))


def fit_spans(patterns: list[tuple[str, str]], counts: np.ndarray) -> np.ndarray:
    """Weights of the span classifier from the counts of (kind, votes, length and features) patterns."""
    if not patterns:
        return np.zeros((len(KINDS), int(_AT[-1])))
    short = sorted({(k, v[: len(LABELERS)]) for k, v in patterns})
    place = {p: i for i, p in enumerate(short)}
    at = np.asarray([place[k, v[: len(LABELERS)]] for k, v in patterns])
    post, _ = reliabilities(short, np.bincount(at, counts, len(short)))
    return span_classifier(patterns, counts, post[at])


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def _scan(batches: Iterator[pa.RecordBatch], names: frozenset[str] = FIRST_NAMES) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        counts, base_text, kinds, starts, ends, seen = [], [], [], [], [], []
        for t in batch.column("text").to_pylist():
            t = t or ""
            base = base_spans(t)
            more = proposals(t, base)
            counts.append([sum(k == kind for k, _, _ in base) for kind in BASE])
            base_text.append(_digest(base))
            kinds.append([k for k, _, _ in base + more])
            starts.append([a for _, a, _ in base + more])
            ends.append([b for _, _, b in base + more])
            seen.append([votes(t, k, a, b, i < len(base), names) + features(t, a, b) for i, (k, a, b) in enumerate(base + more)])
        each = zip(*counts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in each), pa.array(base_text, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(seen, pa.list_(pa.string()))],
            names=["doc_id", *(f"n_{k}" for k in BASE), "base", "kinds", "starts", "ends", "votes"],
        )


_COUNTS = ", ".join(f"n_{k} long" for k in BASE)


def find_personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5, names: Iterable[str] = FIRST_NAMES, most_patterns: int = 20_000) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``df``.

    The counts and the hash are of the base spans; ``spans`` lists these and the candidates whose
    probability is ``least`` or more, as kind:start:end in code points, by kind, then start. ``names`` is the gazetteer of
    given names. The classifier is fitted on the ``most_patterns`` most frequent patterns. Null and empty texts have none. Repeated rows, null ids and extra columns are allowed; an empty table gives an empty
    result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    given = frozenset(names)
    schema = f"doc_id long, {_COUNTS}, base string, kinds array<string>, starts array<long>, ends array<long>, votes array<string>"
    found = written(rows.mapInArrow(lambda batches: _scan(batches, given), schema), "spans")
    tally = found.select(F.explode(F.arrays_zip("kinds", "votes")).alias("s")).groupBy("s.kinds", "s.votes").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kinds", "votes").limit(most_patterns).collect()
    weights = spark.sparkContext.broadcast(fit_spans([(r.kinds, r.votes) for r in tally], np.asarray([r.n for r in tally], dtype=float)))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], bool] = {}
        for batch in batches:
            every = {(k, v) for ks, vs in zip(batch.column("kinds").to_pylist(), batch.column("votes").to_pylist()) for k, v in zip(ks, vs)}
            new = sorted(every - known.keys())
            known = {p: known[p] for p in every & known.keys()} if len(known) > 100_000 else known
            known.update(zip(new, (span_scores(new, weights.value) >= least).tolist()))
            sha, spans = [], []
            for base, *own in zip(*(batch.column(c).to_pylist() for c in ("base", "kinds", "starts", "ends", "votes"))):
                sha.append(hashlib.sha256(base.encode()).hexdigest())
                n = base.count(",") + 1 if base else 0
                more = [(k, a, b) for k, a, b, v in list(zip(*own))[n:] if known[k, v]]
                spans.append(_digest([*list(zip(*own[:3]))[:n], *more]) if more else base)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *(f"n_{k}" for k in BASE))), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return found.mapInArrow(decide, f"doc_id long, {_COUNTS}, base_sha256 string, spans string")

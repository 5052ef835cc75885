"""Personal data: exact base patterns, and further spans from a semi-Markov conditional random field over candidate segments.

Base spans (e-mail, IP address, card number, phone number) are found by their patterns, kind by kind, leftmost and not overlapping, and always
stay. Candidates are segments around at-signs (also written as `at`, `[at]`) and of digit groups with short separators; a segment has at most
GROUPS digit groups or LABELS domain labels, which bounds an entity. A segment of a kind is scored as a whole: its shape, digits, separators,
check digit, brackets, and what is around it. Segments that do not overlap make a labelling; the model is its distribution, trained by
forward-backward, and a text's spans are the best labelling of what the base spans leave, by dynamic programming over segment ends.

Training is weakly supervised: base spans of the corpus in their context, each also rewritten to forms that the patterns miss (no plus sign,
other separators, `[at]`, `dot`) and to decoys (dates, versions, failed check digits, a word before `at` and a host name), and candidates of
the corpus that are no base span. It takes at most SAMPLE spans of each kind and of the rest, those with the least hash of their id and
place, from all documents. Without any base span there is no model, and only base spans are returned.

A null text counts as empty. A null or repeated doc_id is a row like any other. Further columns are kept out of the result. Texts are read
whole; time is linear in their length but for runs of candidates, of which each is in a bounded number of segments.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import materialize, sliced

KINDS = ["email", "ip", "card", "phone"]
SAMPLE = 300
GROUPS, LABELS, LOCAL = 8, 6, 64
BITS = 14
CONTEXT = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a start inside a run of digits matches no more than its first digit
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _order(span: tuple[int, int, int]) -> tuple[int, int]:
    return span[0], span[2]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start and kind. Each is found in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), 0))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=_order)


# candidates and their features

_DOT = r"(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20dot\x20|\x20DOT\x20)"
_AT = re.compile(r"@|\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20at\x20|\x20AT\x20")
_LABEL = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:({_DOT})(?=[A-Za-z0-9-]))?")
_BEFORE = re.compile(rf"(?:[A-Za-z0-9._%+-]+(?:\x20?[\[({{]\x20?(?:dot|DOT)\x20?[\])}}]\x20?|\x20dot\x20|\x20DOT\x20))?[A-Za-z0-9._%+-]+\Z")
_NUMBERS = re.compile(r"[0-9]+(?:(?:[\x20().\[\]/_+-]{1,3}|\x20?[\[({]?dot[\])}]?\x20?)[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


def _kind_of(c: str) -> str:
    return "" if not c else "a" if c.isalpha() else "9" if c.isdigit() else "_" if c.isspace() else c


def _around(text: str, start: int, end: int) -> list[str]:
    words = _WORD.findall(text[max(0, start - 24) : start])
    return [f"l{_kind_of(text[start - 1 : start])}", f"r{_kind_of(text[end : end + 1])}", f"w{words[-1].lower() if words else ''}"]


def _number_features(text: str, start: int, end: int, groups: list[tuple[int, int]], whole: bool) -> tuple[list[str], list[int]]:
    parts = [text[a:b] for a, b in groups]
    digits, seps = "".join(parts), [text[a:b] for (_, a), (b, _) in zip(groups[:-1], groups[1:], strict=True)]
    n, k = len(digits), len(parts)
    kinds = []
    if k == 4 and all(len(p) <= 3 for p in parts) and all("." in s or "dot" in s for s in seps):
        kinds.append(1)
    if 13 <= n <= 19:
        kinds.append(2)
    if 7 <= n <= 15:
        kinds.append(3)
    if not kinds:
        return [], []
    lead = text[start : groups[0][0]]
    each = sorted(set(seps))
    out = ["num", f"n{n}", f"k{k}", "s" + "-".join(str(len(p)) for p in parts), "p" + "|".join(each), f"u{len(each)}", f"lead{lead}", f"whole{whole}", f"n{n}k{k}", f"zero{parts[0][0] == '0'}"]
    out += [f"small{all(int(p) <= 255 for p in parts)}" if k == 4 and max(map(len, parts)) <= 3 else "small", f"luhn{luhn(digits)}" if n >= 13 else "luhn"]
    out += [f"lead{lead}n{n}", f"year{parts[0][:2] in ('19', '20') and len(parts[0]) == 4}"]
    return out + _around(text, start, end), kinds


def candidates(text: str, blocked: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, list[int], list[str]]]:
    """(start, end, kinds, features) of the segments that overlap no blocked span."""
    spans = sorted((a, b) for a, b, _ in blocked)
    starts = np.array([a for a, _ in spans])
    highest = np.maximum.accumulate([b for _, b in spans]) if spans else np.empty(0)

    def free(start: int, end: int) -> bool:
        i = int(np.searchsorted(starts, end)) - 1
        return i < 0 or highest[i] <= start

    out, floor = [], 0
    for m in _AT.finditer(text):
        left = _BEFORE.search(text[max(floor, m.start() - LOCAL) : m.start()])
        floor = m.start()
        if not left:
            continue
        offset = m.start() - len(left.group())
        begins = [offset] + [offset + d.end() for d in re.finditer(_DOT[:-1] + r"|\.)", left.group()) if " " in d.group() or "[" in d.group() or "(" in d.group()]
        at, dots, labels = m.end(), [], []
        while len(labels) < LABELS and (label := _LABEL.match(text, at)):
            labels.append((label.group().removesuffix(label.group(1) or ""), label.start() + len(label.group()) - len(label.group(1) or "")))
            if len(labels) > 1:
                for start in dict.fromkeys(begins):
                    last, end = labels[-1]
                    if free(start, end):
                        local = text[start : m.start()]
                        mark = m.group().strip()
                        forms = sorted({d.strip() for d in dots})
                        features = ["mail", f"at{mark}", "dots" + "|".join(forms), f"at{mark}dots" + "|".join(forms), f"k{len(labels)}", f"more{bool(label.group(1))}", f"tld{len(last) if last.isalpha() else 0}"]
                        features += [f"digit{any(c.isdigit() for c in local)}", f"inner{'.' in local or 'dot' in local}", f"blank{' ' in m.group()}{mark}", f"first{start == offset}", f"at{mark}digit{any(c.isdigit() for c in local)}"]
                        out.append((start, end, [0], features + _around(text, start, end)))
            if not label.group(1):
                break
            dots.append(label.group(1))
            at = label.end()
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m.group())]
        for i in range(len(groups)):
            digits = 0
            for j in range(i, min(len(groups), i + GROUPS)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                start, end = groups[i][0], groups[j][1]
                if digits < 7 and j - i != 3:
                    continue
                lead = 0
                while lead < 2 and start - lead > 0 and text[start - lead - 1] in "+(":
                    lead += 1
                for begin in {start, start - lead}:
                    body = text[begin:end]
                    if body.count("(") == body.count(")") and body.count("[") == body.count("]") and free(begin, end):
                        features, kinds = _number_features(text, begin, end, groups[i : j + 1], i == 0 and j == len(groups) - 1)
                        if kinds:
                            out.append((begin, end, kinds, features))
    return out


def _index(feature: str, kind: int) -> int:
    return zlib.crc32(f"{kind}{feature}".encode()) >> (32 - BITS)


def _scores(weights: np.ndarray, found: list) -> list[tuple[int, int, int, float]]:
    """(end, start, kind, score) of every segment and kind, by end."""
    return sorted((end, start, k, float(weights[[_index(f, k) for f in features]].sum())) for start, end, kinds, features in found for k in kinds)


def best_labelling(segments: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The segments (end, start, kind, score), in order, that do not overlap and have the highest sum; all else scores 0."""
    ends, best, taken = [0], [0.0], [None]
    for end, start, kind, score in segments:
        before = int(np.searchsorted(ends, start, "right")) - 1
        value = best[before] + score
        if value > best[-1]:
            if ends[-1] == end:
                best[-1], taken[-1] = value, (start, end, kind, before)
            else:
                ends.append(end), best.append(value), taken.append((start, end, kind, before))
    out, i = [], len(best) - 1
    while taken[i] is not None:
        start, end, kind, before = taken[i]
        out.append((start, end, kind))
        i = before
    return out[::-1]


# training


def _forms(kind: int, span: str, rng: np.random.Generator) -> list[tuple[str, bool]]:
    """Rewritten spans, and whether they still are personal data of the kind."""
    d = _digits(span)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == 0:
        local, host = span.rsplit("@", 1)
        at = pick(" [at] ", "[at]", " (at) ", "(at)", " {at} ", " at ")
        dot = pick(" dot ", " [dot] ", "[dot]", "(dot)", " (dot) ")
        word = re.sub(r"[^A-Za-z]", "", local) or "it"
        yes = [local + at + host.replace(".", dot), local + pick(" [at] ", "[at]", "(at)", " (at) ") + host, local.replace(".", dot) + " at " + host.replace(".", " dot ")]
        return [(x, True) for x in yes] + [(f"{word} at {host}", False), (f"{word} at {word}.{word}", False)]
    if kind == 1:
        p = span.split(".")
        wide = [str(256 + int(rng.integers(700))) if i == int(rng.integers(4)) or i == 0 else x for i, x in enumerate(p)]
        return [(pick("[.]", "(.)", "[dot]", " dot ", "(dot)").join(p), True), (".".join(wide), False), (".".join(p[:3]), False), ("[.]".join(wide), False), (", ".join(p), False)]
    if kind == 2:
        cut = [d[i : i + 4] for i in range(0, len(d), 4)]
        bad = d[:-1] + str((int(d[-1]) + 1 + int(rng.integers(9))) % 10)
        bad_cut = [bad[i : i + 4] for i in range(0, len(bad), 4)]
        sep = pick(".", "/", "_", " - ", "  ")
        return [(sep.join(cut), True), (bad, False), (" ".join(bad_cut), False), (sep.join(bad_cut), False), (f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", False), (d[:13], False)]
    rest, land = d[-10:], d[:-10] or "1"
    a, b, c = rest[:3], rest[3:6], rest[6:]
    yes = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{land}-{a}-{b}-{c}", f"00{land} {a} {b} {c}", f"+{land}/{a}/{b}-{c}", f"+{land}_{a}_{b}_{c}", f"{land} ({a}) {b}-{c}"]
    year = f"{1950 + int(rng.integers(90))}"
    month, day = f"{1 + int(rng.integers(12)):02d}", f"{1 + int(rng.integers(28)):02d}"
    no = [f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{year}{month}{day}", f"{year}-{month}-{day} {a[0]}{b[0]}", rest, rest[:8], f"{a}, {b}, {c}", f"{year}-{int(year) + 1}", f"{rest[:2]} {rest[2:4]} {rest[4:6]} {rest[6:8]}", f"{day}/{month}/{year}"]
    return [(yes[i], True) for i in rng.permutation(len(yes))[:4]] + [(no[i], False) for i in rng.permutation(len(no))[:4]]


def training_windows(rows: list[tuple[int, str, str, str]]) -> list[tuple[str, list[tuple[int, int, int]], tuple[int, int]]]:
    """(text, gold spans, part of it that is judged) from (kind, before, span, after); kind -1 is a candidate that is no base span."""
    out = []
    for kind, before, span, after in rows:
        rng = np.random.default_rng(zlib.crc32((before + span).encode()))
        forms = [(span, kind >= 0)] + (_forms(kind, span, rng) if kind >= 0 else [])
        for form, good in forms:
            a, b = len(before), len(before) + len(form)
            out.append((before + form + after, [(a, b, kind)] if good else [], (a, b)))
    return out


def train(windows: list[tuple[str, list[tuple[int, int, int]], tuple[int, int]]], steps: int = 120, decay: float = 2e-4) -> np.ndarray:
    """Weights of hashed (kind, feature), by full-batch Adam on the mean log-likelihood of the windows' labellings."""
    rows: list[tuple[int, int, int, int, bool, list[int]]] = []  # window, start, end (as places in the window), kind, gold
    n_places, count = 1, 0
    for text, gold, (a, b) in windows:
        found = [x for x in candidates(text) if x[0] < b and x[1] > a]
        marks = sorted({p for start, end, _, _ in found for p in (start, end)})
        place = {p: i for i, p in enumerate(marks)}
        n_places = max(n_places, len(marks))
        rows += [(count, place[start], place[end], k, (start, end, k) in gold, [_index(f, k) for f in features]) for start, end, kinds, features in found for k in kinds]
        count += bool(found)
    if not rows:
        return np.zeros(1 << BITS)
    rows.sort(key=lambda r: r[2])
    window, start, end = (np.array([r[i] for r in rows]) for i in range(3))
    gold = np.array([r[4] for r in rows], float)
    flat, owner = np.concatenate([r[5] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[5]) for r in rows])
    by_end = [np.flatnonzero(end == j) for j in range(n_places)]
    by_start = [np.flatnonzero(start == j) for j in range(n_places)]
    w = np.zeros(1 << BITS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        score = np.bincount(owner, w[flat], len(rows))
        alpha, beta = np.zeros((n_places, count)), np.zeros((n_places, count))
        for j in range(1, n_places):
            alpha[j] = alpha[j - 1]
            s = by_end[j]
            np.logaddexp.at(alpha[j], window[s], alpha[start[s], window[s]] + score[s])
        for j in range(n_places - 2, -1, -1):
            beta[j] = beta[j + 1]
            s = by_start[j]
            np.logaddexp.at(beta[j], window[s], beta[end[s], window[s]] + score[s])
        marginal = np.exp(alpha[start, window] + score + beta[end, window] - alpha[-1, window])
        gradient = np.bincount(flat, (gold - marginal)[owner], len(w)) / count - decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


# Spark


def _training_rows(docs: DataFrame) -> DataFrame:
    """kind (-1: a candidate that is no base span), before, span, after of every base span and every other candidate region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                rest = candidates(text, base)
                rest = [(x[0], x[1], -1) for i, x in enumerate(rest) if i == 0 or x[0] >= rest[i - 1][1]]  # one of a run
                for start, end, kind in base + rest:
                    out.append({"kind": kind, "before": text[max(0, start - CONTEXT) : start], "span": text[start:end], "after": text[end : end + CONTEXT]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("kind", pa.int32()), ("before", pa.string()), ("span", pa.string()), ("after", pa.string())]))

    return docs.select("text").where("text rlike '[0-9]{2}|@| at |at[\\\\])}]'").mapInArrow(run, "kind int, before string, span string, after string")


def learn(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most `sample` base spans of each kind and as many other candidates, those of least hash."""
    rows = materialize(_training_rows(docs).where("length(span) <= 200").distinct(), "spans")
    chosen = [rows.where(F.col("kind") == k).orderBy(F.xxhash64("before", "span", "after"), "before", "span", "after").limit(sample) for k in (-1, *range(len(KINDS)))]
    found = [tuple(r) for part in chosen for r in part.collect()]
    return train(training_windows(found)) if any(r[0] >= 0 for r in found) else np.zeros(1 << BITS)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans of a text, by start and kind."""
    base = base_spans(text)
    more = best_labelling(_scores(weights, candidates(text, base)))
    return base, sorted(base + more, key=_order)


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (base spans) and spans (all), one row a document."""
    weights = learn(docs) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 26):
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = find_spans(text, weights)
                count = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
                rows.append((*count, hashlib.sha256(_said(base).encode()).hexdigest(), _said(every)))
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    key = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {key}, {counts}, base_sha256 string, spans string")

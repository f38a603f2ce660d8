"""Personal data and secrets in text.

Four base kinds come from fixed patterns with their checks. Three more come from weak supervision: secrets (long runs that mix letters
and digits), account numbers and names. Their candidates are found by a wide pattern; regex, gazetteer and context labelers
each vote for, against, or not at all. All candidates of all documents are counted by kind, votes and features, which are a few bits, so
the counts are bounded. For each kind expectation-maximisation on these counts estimates how reliable each labeler is, and its
beliefs train a logistic span classifier on the features, which decides.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.llm.shared import small_batches

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "name")
#: The base kinds' patterns; fixed values. A lookbehind spares starts inside a run that its first start rules out.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z0-9_-]{16,}+")
_HEX = re.compile(r"[0-9a-fA-F]+")
#: Gazetteers; fixed values: beginnings of keys that public services issue, lengths of account numbers by country, titles, given names.
_ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "AIza", "SG", "eyJ", "npm_", "hf_")
_ACCOUNTS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split())
_GIVEN = frozenset("Alexander Andrea Anthony Barbara Charles Christian Christopher Claudia Daniel David Dorothy Elizabeth Francisco Friedrich Isabella James Jennifer Jessica Johannes Joseph Juan Katharina Linda Margaret Maria Matthew Michael Michelle Nicolas Patricia Pierre Richard Robert Sabine Sebastian Stefan Steven Susan Thomas William Wolfgang".split())
#: Words that stand before each kind; fixed values.
_NAMED = {
    "secret": re.compile(r"(?:api[_ -]?key|access[_ -]?key|secret|token|passw(?:or)?d|passwd|pwd|bearer|authorization|auth|credential|private[_ -]?key|clave|contrase(?:ñ|n)a|schlüssel|kennwort|passwort|jeton|clef?)", re.I),
    "account": re.compile(r"(?:iban|account|konto|cuenta|compte|bank)", re.I),
    "name": re.compile(r"(?:\bname is|\bnamed|\bsigned|\bsignature|\bcontact|\bauthor|\bmein name|\bme llamo|\bje m'appelle)[: ]*$", re.I),
}
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(r"(?<!\w)(?:([A-Z]\w+)\.? )?([A-Z][^\W\d_]+) ([A-Z][^\W\d_]+)(?!\w)")
LABELERS = ("pattern", "gazetteer", "context", "assignment", "mixture")
FEATURES = {
    "secret": ("hex", "usual_length", "issued", "named", "assigned", "quoted", "digits", "long", "both_cases"),
    "account": ("checksum", "country", "named", "digits", "spaced"),
    "name": ("title", "given", "named", "inside"),
}


def _emails(text: str) -> list[tuple[int, int]]:
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in s.split(".")))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind. Ends are exclusive; both count code points."""
    spans = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(*m.span(), 1) for m in _IP.finditer(text) if _is_ip(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                spans.append((*m.span(), 2))
        if "+" in text:
            spans += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1]))]


def _secrets(text: str):
    for m in _RUN.finditer(text):
        s = m[0]
        digits = sum("0" <= c <= "9" for c in s)
        letters = sum(c.isalpha() for c in s)
        if not digits or not letters:
            continue
        before, after = text[max(0, m.start() - 32) : m.start()], text[m.end() : m.end() + 1]
        hexed, usual, issued = bool(_HEX.fullmatch(s)), len(s) in (32, 40, 64, 128), s.startswith(_ISSUED)
        named, assigned = bool(_NAMED["secret"].search(before)), bool(_ASSIGNED.search(before))
        quoted = bool(before) and before[-1] in "\"'" and after == before[-1]
        share, cases = digits / len(s), s != s.lower() and s != s.upper()
        words = max((len(w) for w in re.split(r"[^A-Za-z]+", s)), default=0)
        votes = (1 if hexed and usual else -1 if words > 12 else 0, int(issued), int(named), 1 if assigned else -1 if not quoted else 0, 1 if 0.15 <= share <= 0.85 and words < 8 else -1)
        yield m.start(), m.end(), "secret", votes, (hexed, usual, issued, named, assigned, quoted, share >= 0.2, len(s) >= 24, cases)


def _checks(s: str) -> bool:
    """Whether an account number's two check digits are right."""
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _accounts(text: str):
    """Those whose check digits are right, or that stand after words which announce them."""
    for m in _ACCOUNT.finditer(text):
        s = m[0].replace(" ", "")
        checked, country = _checks(s), _ACCOUNTS.get(s[:2]) == len(s)
        before = text[max(0, m.start() - 40) : m.start()]
        named, digits = bool(_NAMED["account"].search(before)), 2 * sum(c.isdigit() for c in s) >= len(s)
        if not checked and not named:
            continue
        votes = (1 if checked else -1, 1 if country else -1, int(named), int(bool(_ASSIGNED.search(before))), 1 if digits else -1)
        yield m.start(), m.end(), "account", votes, (checked, country, named, digits, " " in m[0])


def _names(text: str):
    """Two words with capitals of which a gazetteer knows the title or the given name, or that stand after words which announce a name."""
    for m in _NAME.finditer(text):
        title, given = m[1] in _TITLES, m[2] in _GIVEN
        start = m.start() if title else m.start(2)
        before = text[max(0, start - 24) : start]
        named = bool(_NAMED["name"].search(before))
        if title or given or named:
            inside = bool(before) and before.rstrip(" ")[-1:] not in (".", "!", "?", "\n", "")
            votes = (int(inside), 1 if title or given else -1, int(named), 0, 1 if min(len(m[2]), len(m[3])) > 2 else -1)
            yield start, m.end(), "name", votes, (title, given, named, inside)


def candidates(text: str) -> list[tuple[int, int, str, tuple[int, ...], tuple[int, ...]]]:
    """(start, end, kind, votes, features) of all candidates; votes are 1, -1 or 0 (none)."""
    found = [*(_secrets(text) if _DIGIT.search(text) else ()), *(_accounts(text) if _DIGIT.search(text) else ()), *_names(text)]
    return [(a, b, k, v, tuple(map(int, f))) for a, b, k, v, f in found]


def vote_counts(docs: DataFrame, text_col: str = "text") -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
    """How many candidates of all texts have which kind, votes and features: at most 3^5 * (2^9 + 2^5 + 2^4) rows, whatever the input."""
    small_batches(docs.sparkSession)

    def counted(batches):
        counts: Counter = Counter()
        for b in batches:
            for text in b.column("text"):
                if text := text.as_py():
                    counts.update(x[2:] for x in candidates(text))
        keys = list(counts)
        joined = lambda i: pa.array([",".join(map(str, k[i])) for k in keys], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), joined(1), joined(2), pa.array([counts[k] for k in keys], pa.int64())], ["kind", "votes", "features", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "kind string, votes string, features string, n bigint").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect()
    return sorted((r["kind"], tuple(map(int, r["votes"].split(","))), tuple(map(int, r["features"].split(","))), r["n"]) for r in rows)


def reliabilities(votes: np.ndarray, n: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation for labelers that err independently given the truth: (belief that each row is a secret,
    accuracy of each labeler, share of secrets). Accuracies start at 0.8 and stay between 0.5 and 0.99."""
    accuracy, share = np.full(votes.shape[1], 0.8), 0.5
    belief = np.zeros(len(votes))
    for _ in range(steps):
        log = np.log(accuracy / (1 - accuracy))
        belief = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + votes @ log, -30, 30)))
        share = float(np.clip((belief * n).sum() / max(n.sum(), 1), 0.02, 0.98))
        right = np.where(votes > 0, belief[:, None], 1 - belief[:, None]) * (votes != 0)
        accuracy = np.clip(((right * n[:, None]).sum(axis=0) + 8) / (((votes != 0) * n[:, None]).sum(axis=0) + 10), 0.5, 0.99)
    return belief, accuracy, share


def _classifier(x: np.ndarray, belief: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, the constant first, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), 1e-2 * n.sum() / 100 + 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (n * (belief - p)) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_spans(docs: DataFrame, text_col: str = "text") -> dict:
    """For each added kind its labelers' accuracies and its classifier's weights; a kind without candidates admits none."""
    counts = vote_counts(docs, text_col)
    model = {}
    for kind in ADDED:
        rows = [r[1:] for r in counts if r[0] == kind]
        if not rows:
            model[kind] = {"weights": np.array([-10.0] + [0.0] * len(FEATURES[kind])), "accuracy": np.full(len(LABELERS), 0.8)}
            continue
        votes, x, n = (np.array([r[i] for r in rows], dtype=float) for i in range(3))
        belief, accuracy, _ = reliabilities(votes, n)
        model[kind] = {"weights": _classifier(x, belief, n), "accuracy": accuracy}
    return model


def _free(a: int, b: int, taken: list[tuple[int, int]]) -> bool:
    """Whether [a, b) meets none of the sorted spans, of which no two overlap."""
    at = bisect_left(taken, (b,))
    return not at or taken[at - 1][1] <= a


def added_spans(text: str, model: dict, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that the classifier admits and that no base span overlaps; of those that overlap each other an account, then a secret."""
    taken: list[tuple[int, int]] = []
    for a, b, _ in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    every = candidates(text)
    found: list[tuple[int, int, str]] = []
    for kind in ("account", "secret", "name") if every else ():
        w, own = model[kind]["weights"], []
        for a, b, k, _, f in every:
            if k == kind and w[0] + float(np.dot(w[1:], f)) > 0 and _free(a, b, taken):
                own.append((a, b))
        found += [(a, b, kind) for a, b in own]
        taken = sorted(taken + own)  # one kind's candidates don't overlap
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_spans(text: str | None, model: dict) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    added = added_spans(text, model, base)
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    return base, sorted(base + added, key=lambda s: (s[0], order[s[2]], s[1]))


def pii_spans(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans) for each row.

    Null and empty texts have no spans: counts of 0, the digest of no bytes and an empty string. Rows are independent,
    so repeated rows and null ids keep theirs. Other columns are ignored. No rows: none. A text of any length is one row in memory.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches):
        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in range(8))
            for text in b.column("text"):
                base, every = find_spans(text.as_py(), sent.value)
                n = Counter(k for _, _, k in base)
                for c, v in zip(out, (*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), len(every)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.string()), pa.array(out[6], pa.int64()), pa.array(out[7], pa.int64())], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(found, f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint, n_spans bigint")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: dict, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets; `length_col`, where docs has it, counts code points anew.

    Overlapping spans become one, named by the first. Texts without spans, null and empty ones stay as they are. No rows: none.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def masked(text: str | None) -> str | None:
        _, spans = find_spans(text, sent.value)
        if not spans:
            return text
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def replaced(batches):
        for b in batches:
            yield b.set_column(0, "text", pa.array([masked(t.as_py()) for t in b.column(0)], pa.string()))

    others = [c for c in docs.columns if c != text_col]
    names = [f"c{i}" for i in range(len(others))]
    renamed = docs.select(F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)))
    out = renamed.mapInArrow(replaced, "text string" + "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(others, names, strict=True)))
    out = out.toDF(text_col, *others).select(*(F.col(f"`{c}`") for c in docs.columns))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col and length_col in docs.columns else out

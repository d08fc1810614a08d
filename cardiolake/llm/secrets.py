"""Operator 5 - secret scans with a linear-chain conditional random field.

Fixed patterns give the base spans.  Beside them every text is a sequence of
tokens - runs of the characters secrets are made of, and single other signs -
tagged begin, inside or outside.  A token may be begin or inside if it is a run
with a digit of ``LEAST`` or more characters, a run of ``LONG`` or more of high
entropy, starts like a known kind of key, follows an assignment sign or holds one,
or is one of the ``REACH`` runs after a key word, with or without a digit.  All
others are outside by definition of the lattice, so the Viterbi decoding of a whole
text falls apart exactly into the decodings of its runs of candidates, each between
two outside tokens, and plain words cost nothing.  Features: shape (length, share of
digits, case, hexadecimal, entropy, known prefixes), the neighbouring words (a key
word, an assignment sign, quotes) and the file (how many key words, how dense in
digits).  The model is trained here, by gradient ascent on the log-likelihood
with forward-backward sums, on sentences made by a fixed generator; its weights are kept
in ``secrets_weights.json`` (``write_weights``).

Scale: a map over Arrow batches without shuffle; the model is a few hundred
numbers in the task closure.

Defined results: null and empty texts have no spans; very long texts are scanned
whole, runs and words of any length too; of paths of equal score the decoding takes the tag
listed first (begin, inside, outside); repeated rows get equal results; a null doc_id is allowed; empty tables give empty results; columns of
other names are ignored (``redact`` passes them through and keeps n_chars, if
there is one, equal to the new length).
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import pathlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed patterns of the base spans, by kind, in the listed order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
_HINTS = ("passw", "secret", "token", "api")

LEAST, LONG, REACH = 8, 12, 4
ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_WORD = re.compile(r"[+/_.=-]*[A-Za-z0-9][A-Za-z0-9+/_.=-]*")
_LONG = re.compile(r"[A-Za-z+/_.=-]{%d,}" % LONG)
_ASSIGNED = re.compile(r"[:=]\s{0,3}[\"'`]?(?=[A-Za-z0-9+/_.=-])")
_CAMEL = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
_PLAIN = re.compile(r"[A-Z]?[a-z]+")
_SAYS = frozenset(("is", "was", "to", "be", "now", "use", "with"))  # words that may stand between a key word and a secret
_DIGIT = re.compile(r"[0-9]")
_KEYWORD = re.compile(r"passw|passphrase|pwd|secret|token|api|key|auth|credential|bearer|access|private", re.I | re.A)
_KEY_HINTS = ("passw", "passphrase", "pwd", "secret", "token", "api", "key", "auth", "credential", "bearer", "access", "private")
_PREFIX = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?:AKIA|ASIA|ghp_|gho_|glpat-|sk-|sk_|pk_|xox[bap]-|eyJ|AIza)")
FEATURES = (
    "bias", "len>=12", "len>=16", "len>=24", "len>=36", "len>=64", "digits>.1", "digits>.3", "digits>.6", "digits=1", "mixed", "upper+digit", "hex",
    "entropy>2.5", "entropy>3.3", "entropy>4", "prefix", "word.number", "dots", "dashes", "slashes", "vowels>.3",
    "key-1", "key-2", "key-3", "assign-1", "quote-1", "quote+1", "space-1", "space+1", "at+1", "colon-1", "file:keys", "file:digits", "same-run",
    "key-4", "key-1,assign-1", "key-1,space-1", "key in quote", "self-key", "self-key,assigned", "digit", "len<4", "len<8", "camel", "plain", "capitals", "//", "assign-1,camel", "plain,assign-1",
    "key-2,is-1", "key-2,is-1,digit", "key-2,is-1,len>=16", "login:x@", "key-1,len>=16", "key-1,quote-1",
    "line-1", "line-1,len>=24", "line-1,both len>=24",
)
B, I, O = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, kinds as listed."""
    out, low = [], text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that may be secrets (see the module), without a full stop at the end."""
    found: dict[int, int] = {}
    run, worded, seen = (0, 0), False, -1  # the run looked at last and whether it holds a word: rules meet a long run again and again

    def take(at: int, least: int = 1, entropy: float = 0.0) -> int:
        """Add the run around ``at``; where it ends."""
        nonlocal run, worded
        if not run[0] <= at < run[1]:
            start = at
            while start and text[start - 1] in ALPHABET:
                start -= 1
            run = start, _RUN.match(text, start).end()
            worded = bool(_WORD.match(text, start, run[1] - (text[run[1] - 1] == ".")))
        start, stop = run
        end = stop - (text[stop - 1] == ".")  # a full stop ends a sentence, not a secret
        if worded and start not in found and end - start >= least and (not entropy or _entropy(text[start:end]) > entropy):
            found[start] = end
        return stop

    at = 0
    while m := _DIGIT.search(text, at):
        at = take(m.start(), LEAST)
    for m in _LONG.finditer(text):
        if m.start() >= seen:
            seen = take(m.start(), LONG, 2.5)
    for m in _PREFIX.finditer(text):
        take(m.start())
    if ":" in text or "=" in text:
        for m in _ASSIGNED.finditer(text):
            take(m.end())
    low, begun = text.lower(), -1
    if any(h in low for h in _KEY_HINTS):
        for m in _KEYWORD.finditer(text):
            at = take(m.start(), len(text) + 1)  # the end of the key word's own run
            if at == begun:
                continue
            begun = at
            for _ in range(REACH):
                word = _WORD.search(text, at)
                if not word:
                    break
                at = take(word.start())
    return sorted(found.items())


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _before(text: str, at: int) -> str:
    """What stands before ``at``, from the beginning of the ``REACH``-th last word on, however long the words are."""
    size = 64
    while True:
        low = max(0, at - size)
        words = list(_WORD.finditer(text, low, at))
        if len(words) > REACH:  # so that the first of the last ones is whole
            return text[words[-REACH].start() : at]
        if not low:
            return text[words[-REACH].start() if len(words) == REACH else 0 : at]
        size *= 4


def features(text: str, spans: list[tuple[int, int]], file_keys: bool, file_digits: bool) -> np.ndarray:
    """One 0/1 row per candidate, columns as in ``FEATURES``."""
    x = np.zeros((len(spans), len(FEATURES)), dtype=np.float64)
    for i, (a, b) in enumerate(spans):
        s, n = text[a:b], b - a
        digits = sum(c.isdigit() for c in s) / n
        upper, lower = any("A" <= c <= "Z" for c in s), any("a" <= c <= "z" for c in s)
        before = _before(text, a)
        gap = text[spans[i - 1][1] : a] if i and a - spans[i - 1][1] <= 2 else ""
        line = gap in ("\n", "\r\n")
        words = _WORD.findall(before)
        keys = [bool(_KEYWORD.search(w)) for w in words[: -REACH - 1 : -1]] + [False] * REACH
        near = text[max(0, a - 4) : a]
        assigned = bool(re.search(r"[:=]\s*[\"']?$", near)) or "=" in s[:-2]
        own, plain, camel = bool(_KEYWORD.search(s)), bool(_PLAIN.fullmatch(s)), bool(_CAMEL.search(s))
        e = _entropy(s)
        vowels = sum(c in "aeiouAEIOU" for c in s) / n
        said = bool(words) and words[-1].lower() in _SAYS and not assigned
        quoted = any(keys) and (before.count('"') % 2 == 1 or before.count("'") % 2 == 1)
        x[i] = (
            1, n >= 12, n >= 16, n >= 24, n >= 36, n >= 64, digits > 0.1, digits > 0.3, digits > 0.6, digits == 1, upper and lower, upper and not lower, all(c in "0123456789abcdef" for c in s),
            e > 2.5, e > 3.3, e > 4, bool(_PREFIX.match(s)), bool(re.fullmatch(r"[A-Za-z]+[-_.]?[0-9]{1,4}", s)), s.count(".") >= 2, s.count("-") >= 2, s.count("/") >= 2, vowels > 0.3,
            keys[0], keys[1], keys[2], assigned,
            near[-1:] in "\"'`" and near != "", text[b : b + 1] in "\"'`" and b < len(text), near[-1:] in " \n\t", text[b : b + 1] in " \n\t.,", "@" in text[b : b + 2] or "@" in near, near[-1:] == ":",
            file_keys, file_digits, i > 0 and a - spans[i - 1][1] <= 2,
            keys[3], keys[0] and assigned, keys[0] and near[-1:] in " \n\t", quoted, own, own and "=" in s[:-2],
            digits > 0, n < 4, n < 8, camel, plain, s.isupper() and digits == 0, s.startswith("//"), assigned and camel, plain and assigned,
            keys[1] and said, keys[1] and said and digits > 0, keys[1] and said and n >= 16, near[-1:] == ":" and text[b : b + 1] == "@" and "//" in before, keys[0] and n >= 16, keys[0] and near[-1:] in "\"'`" and near != "",
            line, line and n >= 24, line and n >= 24 and spans[i - 1][1] - spans[i - 1][0] >= 24 and e > 3.3,
        )
    return x


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best tags of one run of candidates between two outside tokens."""
    score, back = trans[O] + emit[0], []
    for e in emit[1:]:
        step = score[:, None] + trans
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + e
    tag = int((score + trans[:, O]).argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return tags[::-1]


def chains(spans: list[tuple[int, int]], text: str) -> list[list[int]]:
    """Candidate numbers grouped into runs with no other token between them."""
    out: list[list[int]] = []
    for i, (a, _) in enumerate(spans):
        if i and not text[spans[i - 1][1] : a].strip():
            out[-1].append(i)
        else:
            out.append([i])
    return out


# --- training -----------------------------------------------------------------


def training_texts(n: int = 2500, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Sentences with known secrets, and look-alikes without, by a fixed generator."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda abc, k: "".join(abc[int(i)] for i in rng.integers(len(abc), size=k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: chars(low, int(rng.integers(2, 11)))
    secret = [
        lambda: chars("0123456789abcdef", int(rng.choice([24, 32, 40, 64]))),
        lambda: "AKIA" + chars(up + dig, 16),
        lambda: "ghp_" + chars(low + up + dig, 36),
        lambda: "sk-" + chars(low + up + dig, int(rng.integers(24, 48))),
        lambda: "eyJ" + chars(low + up + dig, 20) + "." + chars(low + up + dig + "_-", 40) + "." + chars(low + up + dig + "_-", 43),
        lambda: chars(low + up + dig + "+/", int(rng.choice([28, 40, 44, 64]))) + pick(["", "=", "=="]),
        lambda: chars(low + up + dig, int(rng.integers(10, 24))) + pick(dig),
        lambda: word().capitalize() + chars(dig, int(rng.integers(2, 6))) + pick(["", "_x", "-" + word()]),
        lambda: "".join(word().capitalize() for _ in range(int(rng.integers(2, 5)))),
        lambda: chars(low, int(rng.integers(5, 12))),
        lambda: chars(low + up + dig, int(rng.integers(4, 8))),
        lambda: " ".join(word() for _ in range(int(rng.integers(3, 5)))),
        lambda: chars(low + up, int(rng.integers(16, 48))),
        lambda: "\n".join(chars(low + up + "+/", 64) for _ in range(int(rng.integers(1, 4)))),
        lambda: pick(["sk-", "ghp_", "glpat-"]) + chars(low + up, int(rng.integers(20, 40))),
        lambda: chars(low, int(rng.integers(16, 30))),
        lambda: word() + chars(dig, int(rng.integers(1, 5))),
        lambda: chars(low + up + dig, int(rng.integers(6, 20))),
    ]
    spoken, login = {6, 7, 15, 16}, 17  # kinds that may follow "is"; the kind inside an address
    phrase, free = 11, {0, 1, 2, 3, 4, 5, 12, 13, 14}  # kinds in quotes only, kinds known without a sign
    keyed = ["password", "passwd", "secret", "token", "api_key", "apikey", "access key", "auth_token", "client_secret", "Authorization Bearer", "private key", "passphrase", "wifi key", "pwd", "credential", "Authorization: Bearer"]
    plain = [
        lambda: "-".join(chars(dig, k) for k in (3, 3, 4)),
        lambda: "+" + chars(dig, int(rng.integers(9, 13))),
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
        lambda: ".".join(str(int(v)) for v in rng.integers(1, 255, size=4)),
        lambda: word() + chars(dig, int(rng.integers(1, 5))),
        lambda: word() + "/" + word() + "/" + chars(dig, int(rng.integers(1, 5))) + ".html",
        lambda: word() + "." + word() + chars(dig, 2) + "@" + word() + ".example.com",
        lambda: chars(dig, int(rng.integers(8, 17))),
        lambda: word() + "-" + word() + "-" + chars(dig, 2) + "-" + word(),
        lambda: "v" + ".".join(chars(dig, 1) for _ in range(3)) + "-" + word(),
        lambda: " ".join(chars(dig, 4) for _ in range(4)),
        lambda: pick(["token", "key", "access", "secret", "password", "auth", "private", "keys", "Secret", "credentials"]) + " " + " ".join(word() for _ in range(int(rng.integers(2, 6)))),
        lambda: pick(["a ", "the "]) + pick(["token of ", "key to ", "access for ", "secret in ", "password or "]) + word() + ". " + word().capitalize(),
        lambda: pick([word(), word().capitalize()]) + pick([": ", " = ", "=", ' = "', ":"]) + pick([word(), word().capitalize(), chars(dig, 3)]) + " " + word(),
        lambda: pick(["http", "https"]) + "://" + word() + ".example.com/" + word() + pick(["", "/" + word() + "-" + word(), ".html"]),
        lambda: chars(dig, 2) + ":" + chars(dig, 2),
        lambda: pick(["token", "key", "access", "secret", "password", "credential", "passphrase"]) + pick([" is ", " was ", " is now ", " to be "]) + word() + " " + word(),
        lambda: pick(["token", "key", "secret", "password"]) + " " + pick(['"', "'"]) + word() + pick(["", " " + word()]) + pick(['"', "'"]) + " " + word(),
        lambda: chars(low, int(rng.integers(12, 20))),
        lambda: word() + pick("-_./") + word() + pick("-_./") + word(),
        lambda: word().capitalize() + word().capitalize(),
        lambda: word() + "@" + word() + ".example.com",
        lambda: word().upper() + pick([" ", ": ", ""]) + word().upper(),
    ]
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += " ".join(word() for _ in range(int(rng.integers(1, 9)))) + pick([" ", ". ", "\n"])
            if rng.random() < 0.5:
                kind = int(rng.integers(len(secret)))
                s = secret[kind]()
                if kind == login:
                    text += pick(["postgres", "https", "mysql", "amqp"]) + "://" + word() + ":"
                    quote = "@" + word() + pick([".example.com", ".internal"]) + pick(["", ":5432"]) + "/" + word()
                elif kind not in free or rng.random() < 0.7:
                    key = pick(keyed)
                    quote = pick(['"', "'"] if kind == phrase else ["", '"', "'"])
                    signs = [" = ", "=", ": "] + [" is ", " "] * (kind in free) + [" is ", " was ", " is now "] * (kind in spoken) + [" ", " is "] * (kind == phrase)
                    text += key + (" " if "Bearer" in key and kind in free | spoken else pick(signs)) + quote
                else:
                    quote = ""
                start = len(text)
                while kind != login and start and text[start - 1] in ALPHABET:  # key=value is one run
                    start -= 1
                gold.append((start, len(text) + len(s)))
                text += s + quote
            else:
                text += pick(plain)()
            text += pick([" ", ". ", ", ", "\n"])
        out.append((text, gold))
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def fit(samples, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights [features, 3], transitions [3, 3]) by gradient ascent."""
    by_length: dict[int, list] = {}
    for text, gold in samples:
        spans = candidates(text)
        if not spans:
            continue
        x = features(text, spans, *file_features(text))
        for run in chains(spans, text):
            y, open_until = [], -1
            for i in run:
                inside = next((g for g in gold if g[0] <= spans[i][0] < g[1] or spans[i][0] <= g[0] < spans[i][1]), None)
                y.append(O if inside is None else I if inside[1] == open_until else B)
                open_until = inside[1] if inside else -1
            by_length.setdefault(len(run), []).append((x[run], y))
    groups = [(np.stack([r[0] for r in rows]), np.array([r[1] for r in rows])) for rows in by_length.values()]
    n = sum(len(y) for _, y in groups)
    w, t = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    t[O, I] = -4.0  # inside never starts a secret
    moments = [np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        gw, gt = -ridge * n * w, -ridge * n * t
        for x, y in groups:
            e, length = x @ w, y.shape[1]
            f = [t[O] + e[:, 0]]
            for i in range(1, length):
                f.append(_log_sum(f[-1][:, :, None] + t, 1) + e[:, i])
            b = [np.broadcast_to(t[:, O], (len(y), 3))]
            for i in range(length - 1, 0, -1):
                b.insert(0, _log_sum(t + (e[:, i] + b[0])[:, None, :], 2))
            z = _log_sum(f[-1] + t[:, O], 1)
            for i in range(length):
                p = np.exp(f[i] + b[i] - z[:, None])
                true = np.eye(3)[y[:, i]]
                gw += x[:, i].T @ (true - p)
                if i:
                    pair = np.exp(f[i - 1][:, :, None] + t + (e[:, i] + b[i])[:, None, :] - z[:, None, None])
                    gt += np.einsum("na,nb->ab", np.eye(3)[y[:, i - 1]], true) - pair.sum(axis=0)
                else:
                    gt[O] += (true - p).sum(axis=0)
                if i == length - 1:
                    gt[:, O] += (true - p).sum(axis=0)
        for v, g, k in ((w, gw / n, 0), (t, gt / n, 1)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.999 * moments[k + 2] + 0.001 * g * g
            v += rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.999**step)) + 1e-8)
    return w, t


WEIGHTS = pathlib.Path(__file__).with_name("secrets_weights.json")


def write_weights() -> None:
    """Fit on the training sentences and keep the numbers beside this module."""
    w, t = fit(training_texts())
    rows = {name: [round(float(v), 4) for v in row] for name, row in zip(FEATURES, w)}
    WEIGHTS.write_text(json.dumps({"emission": rows, "transition": [[round(float(v), 4) for v in row] for row in t]}, indent=0) + "\n")


@functools.lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """The weights that ``fit`` finds on ``training_texts``, as written by ``write_weights``."""
    kept = json.loads(WEIGHTS.read_text())
    if list(kept["emission"]) != list(FEATURES):
        raise ValueError("the written weights are of other features: call write_weights()")
    return np.array(list(kept["emission"].values())), np.array(kept["transition"])


# --- application ----------------------------------------------------------------


def file_features(text: str) -> tuple[bool, bool]:
    low = text.lower()
    return any(h in low for h in _KEY_HINTS), len(_DIGIT.findall(text)) > 0.02 * len(text)


def crf_spans(text: str, weights: np.ndarray, trans: np.ndarray) -> list[tuple[int, int]]:
    """Spans tagged as secrets in one whole text."""
    spans = candidates(text)
    if not spans:
        return []
    emit, out = features(text, spans, *file_features(text)) @ weights, []
    for run in chains(spans, text):
        for i, tag in zip(run, viterbi(emit[run], trans)):
            if tag == B:
                out.append(spans[i])
            elif tag == I and out:
                out[-1] = (out[-1][0], spans[i][1])
    return out


def all_spans(text: str | None, weights: np.ndarray, trans: np.ndarray) -> tuple[list, list]:
    """(base spans, base and added spans), each sorted by start, then kind as listed."""
    if not text:
        return [], []
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
    added = [(a, b, "crf") for a, b in crf_spans(text, weights, trans) if not any(a < e and s < b for s, e, _ in base)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of ``rows`` texts, so that few are held as Python strings at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document; see ``SCHEMA``."""
    weights, trans = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in _slices(batches):
            counts, digests, joined = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text, weights, trans)
                n = Counter(s[2] for s in base)
                counts.append([n[k] for k in KINDS[:3]] + [len(every) - len(base)])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(every))
            c = np.asarray(counts, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, i]) for i in range(3)), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(c[:, 3])], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``."""
    weights, trans = model()
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None) -> str | None:
        spans = all_spans(text, weights, trans)[1]
        if not spans:
            return text
        out, last = [], 0
        for a, b, _ in spans:
            if b > last:
                out += [text[last : max(last, a)], mark] if a >= last else []
                last = b
        return "".join(out) + text[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            columns, old = list(batch.columns), batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if count is not None:
                kept = columns[count].to_pylist()
                columns[count] = pa.array([k if a is b or a is None else len(b) for k, a, b in zip(kept, old, new)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract query: base spans and added spans of every document."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

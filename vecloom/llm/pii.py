"""Personal data: generators propose overlapping spans, gradient-boosted trees judge them, calibrated thresholds select."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import append, documents, unused

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"

# --- Base patterns -----------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can't begin inside a run of digits: it would have begun at the run's first digit, or failed there alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, leftmost and not overlapping within a kind, in order of kind and start.

    An e-mail address is looked for at each at sign, in time linear in the text; all starts that share an at sign match alike.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append(("email", start, done))
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-12:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- Candidates --------------------------------------------------------------------------------------------------

# Starts at the beginning of a run of characters that may stand before the at sign, so that a long run is read once. A
# plain dot joins labels where no space follows alone: the next sentence isn't part of an address.
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[ ]?(?:@|[(\[{]at[)\]}])[ ]?[A-Za-z0-9-]++(?:(?:\.|[ ]\.[ ]?|[ ]?[(\[{]dot[)\]}][ ]?)[A-Za-z0-9-]++)++", re.I)
_NUMBER = re.compile(r"\+?\(?(?<![0-9])[0-9](?:[ ().\-/]{0,2}[0-9]){6,}+")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|[(\[{]dot[)\]}]) ?[0-9]{1,3}){3}(?![0-9])", re.I)
_KEYED = re.compile(r"\b(?:[a-z]{1,20}[_-])?(?:token|secret|passwd|password|pwd|key|auth|bearer)\b[\"']?\s{0,2}[:=]\s{0,2}[\"']?([^\s\"'<>,;]{6,}+)", re.I)
_BARE = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+")
#: Signed web tokens: three parts in base64, the first of a JSON object.
_SIGNED = re.compile(r"(?<![A-Za-z0-9_+/.-])eyJ[A-Za-z0-9_-]*+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
_DOT, _GROUP = re.compile(r"\."), re.compile(r"[0-9]+")
#: Candidates judged at once; numbers parted by blanks alone can give ten and more a group.
JUDGED = 20_000


def candidates(text: str, data: bytes | None = None) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal data, many more than are: of each number every group of digits, and every run of groups, of 7 to 19 digits."""
    data = text.encode("utf-8", "surrogatepass") if data is None else data
    out = []
    if b"@" in data or b"at)" in (low := data.lower()) or b"at]" in low or b"at}" in low:
        out += [("email", *m.span()) for m in _AT.finditer(text)]
    if b"=" in data or b":" in data:
        out += [("secret", *m.span(1)) for m in _KEYED.finditer(text)]
    signed = [m.span() for m in _SIGNED.finditer(text)] if b"eyJ" in data else []
    out += [("secret", *s) for s in signed]
    if len(data.translate(None, b"0123456789")) == len(data):
        return out
    out += [("ip", *m.span()) for m in _QUAD.finditer(text)]
    starts = {a for a, b in signed for a in (a, *(m.end() for m in _DOT.finditer(text, a, b)))}
    out += [("secret", *m.span()) for m in _BARE.finditer(text) if m.start() not in starts]  # parts of a signed token aren't keys
    for m in _NUMBER.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            a, n = start, 0
            if a > m.start() and text[a - 1] == "(":
                a -= 1
            if a > m.start() and text[a - 1] == "+":
                a -= 1
            for first, b in groups[i : i + 19]:
                n += b - first
                if n > 19:
                    break
                if 7 <= n <= 15:
                    out.append(("phone", a, b))
                if 13 <= n:
                    out.append(("card", a, b))
    return sorted(set(out), key=lambda s: (s[1], s[2], s[0]))


_WORDS = (
    re.compile(r"mail|contact|write|reach", re.I), re.compile(r"phone|\btel|call|fax|mobile|cell|dial|ring", re.I), re.compile(r"card|visa|master|amex|payment|credit|debit", re.I),
    re.compile(r"token|secret|passw|pwd|key|auth|bearer|credential", re.I), re.compile(r"\bip\b|host|address|server|from|client", re.I),
    re.compile(r"order|isbn|version|invoice|\bno\b|#|\bid\b|\bref|date|serial|sha|md5|commit|hash|total|page|item|build|euro|usd|[$€£]", re.I),
    re.compile(r"base64,|data:|https?:|www\.", re.I),
)


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format of the span and its context: 40 characters before, one after."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 1]
    digits, groups = _digits(s), _GROUP.findall(s)
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values())
    letters, sizes = sum(c.isalpha() for c in s), [len(g) for g in groups] or [0]
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), letters, s.count(" "), s.count("."), s.count("-"), s.count("(") - s.count(")"), s.count("/"),
        float(s[0] == "+"), float("(" in s), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], float(luhn(digits)) if digits else 0.0,
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)), entropy, sum(c in "0123456789abcdefABCDEF" for c in s) / len(s),
        sum(c.isupper() for c in s) / max(1, letters), sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:])) / len(s), _class(before[-1:]), _class(after),
        *(float(bool(w.search(before))) for w in _WORDS), float(bool(groups) and len(groups[0]) == 4 and groups[0][:2] in ("19", "20")),
    ]


# --- Boosted trees -----------------------------------------------------------------------------------------------


class Trees:
    """Gradient boosting on the log loss: complete trees of `depth` levels, Newton steps, cuts between binned values."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.ridge, self.bins = rounds, depth, rate, ridge, bins
        self.start, self.trees = 0.0, []

    def fit(self, x, y) -> Trees:
        import numpy as np

        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], 1)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        logit, width = np.full(len(y), self.start), self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-logit))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                n = 2**level
                best = np.full(n, 1e-9)
                total_g, total_h = np.bincount(node, g, n), np.bincount(node, h, n)
                own = total_g**2 / (total_h + self.ridge)
                for f, q in enumerate(cuts):
                    if not len(q):
                        continue
                    key = node * width + binned[:, f]
                    left_g = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)[:, : len(q)]
                    left_h = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)[:, : len(q)]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - own[:, None]
                    at = gain.argmax(1)
                    top = gain[np.arange(n), at]
                    for k in np.flatnonzero(top > best + 1e-12):
                        best[k] = top[k]
                        feature[n - 1 + k], cut[n - 1 + k] = f, q[at[k]]
                node = 2 * node + (x[np.arange(len(y)), feature[n - 1 + node]] > cut[n - 1 + node])
            leaf = self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.ridge)
            self.trees.append((feature, cut, leaf))
            logit += leaf[node]
        return self

    def predict(self, x):
        import numpy as np

        logit, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            logit += leaf[node]
        return 1 / (1 + np.exp(-logit))


# --- Training examples -------------------------------------------------------------------------------------------


def _card(rng, n: int, good: bool) -> str:
    d = "".join(rng.choices("0123456789", k=n - 1))
    for c in "0123456789":
        if luhn(d + c):
            return d + (c if good else str((int(c) + rng.randint(1, 9)) % 10))
    raise AssertionError


def examples(n: int, seed: int = 11) -> list[tuple[str, tuple[int, int], str | None]]:
    """n invented (text, place, kind) with one item each: personal data of a kind, or (kind None) what merely looks like it."""
    import random

    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9)))
    mixed = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    upper = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=k))
    four = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    base64 = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=k))
    signed = lambda: f"eyJ{mixed(rng.randint(17, 60))}.eyJ{mixed(rng.randint(40, 1500))}.{mixed(pick([43, 86, 342]))}"
    pick = rng.choice
    good = {
        "email": lambda: pick(["{a}.{n}@{b}.{c}.com", "{a}@{b}.org", "{a} (at) {b} (dot) com", "{a}[at]{b}.net", "{a} [at] {b} [dot] de", "{a}_{n}@{b}.co.uk", "{a} @ {b}.com"]).format(a=word(), b=word(), c=word(), n=digits(2)),
        "ip": lambda: pick([".", ".", ".", " . ", "[.]", "(dot)"][:4]).join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": lambda: pick([lambda d: d, lambda d: d, lambda d: four(d, " "), lambda d: four(d, "-")])(_card(rng, pick([16, 16, 16, 15, 13, 19]), True)),
        "phone": lambda: pick(["+1 ({a}) {b}-{d}", "({a}) {b}-{d}", "{a}-{b}-{d}", "{a}.{b}.{d}", "+44 20 {d} {e}", "0{a} {b} {d}", "+49 {a} {b}{d}", "{a}{b}{d}", "0{f} {f} {f} {f} {f}"]).format(a=digits(3), b=digits(3), d=digits(4), e=digits(4), f=digits(2)),
        "key": lambda: pick([lambda: pick(["AKIA", "ASIA"]) + upper(16), lambda: pick(["ghp_", "glpat-", "xoxb-", "sk-"]) + mixed(rng.randint(24, 36)), lambda: mixed(rng.randint(28, 44)), signed, lambda: base64(rng.randint(60, 2000))])(),
        "secret": lambda: pick([lambda: hexes(40), lambda: hexes(32), lambda: mixed(rng.randint(20, 44)), lambda: "sk-" + mixed(32), signed, lambda: base64(rng.randint(60, 2000)), lambda: mixed(rng.randint(60, 2000)), lambda: hexes(rng.randint(64, 512)), lambda: word() + pick("!#$%&") + digits(4) + mixed(3)])(),
    }
    lead = {
        "email": ["mail ", "contact: ", "", "", "write to "], "ip": ["from ", "host ", "", "ip: ", ""], "card": ["card ", "", "visa: ", "", "credit card no. "], "phone": ["call ", "tel: ", "phone ", "mobile: ", "fax ", "", ""],
        "secret": ['token = "', "api_key=", "password: ", 'secret = "', "auth: ", "access-token: "],
    }
    bad = [
        lambda: ("order ", _card(rng, 16, False)), lambda: ("", _card(rng, 16, False)), lambda: ("card ", _card(rng, 16, False)), lambda: ("", four(_card(rng, 16, False), " ")), lambda: ("invoice no. ", digits(rng.randint(8, 14))),
        lambda: ("isbn ", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"), lambda: ("on ", f"{pick(['19', '20'])}{digits(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}"),
        lambda: ("", f"{pick(['19', '20'])}{digits(2)}-{pick(['19', '20'])}{digits(2)}"), lambda: ("version ", f"{digits(1)}.{digits(3)}.{rng.randint(256, 999)}.{rng.randint(256, 999)}"), lambda: ("", f"{digits(3)}.{rng.randint(256, 999)}.{digits(2)}.{digits(1)}"),
        lambda: ("total ", f"{digits(3)} {digits(3)} {digits(3)}"), lambda: ("", f"{digits(7)}"), lambda: ("", digits(rng.randint(7, 19)) if rng.random() < 0.3 else _card(rng, pick([13, 16, 19]), False)), lambda: ("at ", f"{word()} @ {word()}"), lambda: ("", f"{word()} (at) {word()}"), lambda: ("key: ", word() + word()),
        lambda: ("token = ", word() + "_" + word()), lambda: ("password: ", word() + word()[:4]), lambda: ("sha256: ", hexes(64)), lambda: ("commit ", hexes(40)), lambda: ("", "-".join(word() for _ in range(5)) + "-" + digits(2)), lambda: ("", f"{digits(4)}/{digits(4)}/{digits(4)}"),
        lambda: ("", word().upper() + digits(rng.randint(8, 14))), lambda: ("", pick("ABSX") + digits(rng.randint(15, 20))), lambda: ("", word() + pick("-_") + word() + pick("-_") + word() + digits(2)), lambda: ("", word() + digits(12)),
        lambda: ("", f"{digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(2)}"), lambda: ("", f"{word()}_{word()}_{word()}_{word()}_{word()}{digits(2)}"),
        lambda: (f"data:image/{pick(['png', 'gif', 'jpeg'])};base64,", base64(rng.randint(60, 2000))), lambda: ("", pick("-_/").join(word() for _ in range(rng.randint(5, 80))) + digits(2)),
        lambda: (pick(["key: ", "token: ", "auth: "]), "".join(rng.choices("的一是不了人我在有他这中大来上国", k=rng.randint(6, 300)))), lambda: (pick(["key: ", "token = ", "https://www."]), pick("-_/.").join(word() for _ in range(rng.randint(3, 60)))),
    ]
    out = []
    for i in range(n):
        before = "".join(word() + pick([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rng.randint(0, 12)))
        if i % 2:
            kind = [*KINDS, "key"][(i // 2) % (len(KINDS) + 1)]
            intro, item = pick(lead.get(kind, [""])), good[kind]()
            kind = "secret" if kind == "key" else kind
        else:
            kind, (intro, item) = None, pick(bad)()
        after = ('"' if intro.endswith('"') else "") + pick([" ", ". ", ", ", "\n", ".\n", ""])
        after += " ".join(word() for _ in range(rng.randint(0, 6))) if after not in ("", '"') else ""
        start = len(before) + len(intro)
        out.append((before + intro + item + after, (start, start + len(item)), kind))
    return out


def lists(n: int, seed: int = 12) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """n invented (text, items) with a row of 2 to 8 numbers written alike: phones, cards, or what is neither."""
    import random

    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    pick, out = rng.choice, []
    phone = ["({a}) {b}-{d}", "{a}-{b}-{d}", "{a}.{b}.{d}", "+44 20 {d} {e}", "0{a} {b} {d}", "{a}{b}{d}"]
    for i in range(n):
        kind = ("phone", "card", None)[i % 3]
        if kind == "phone":
            form = pick(phone)
            same = {"a": digits(3), "b": digits(3)} if i % 2 else {}
            make = lambda: form.format(**({"a": digits(3), "b": digits(3)} | same), d=digits(4), e=digits(4))  # noqa: B023, E731
        elif kind == "card":
            part = pick(["", "", " ", "-"])
            make = lambda: part.join(re.findall(".{1,4}", _card(rng, 16, True)))  # noqa: B023, E731
        else:
            sizes = pick([[1], [1, 2], [2, 3], [3], [4], [5, 6], [16]])
            make = lambda: _card(rng, 16, False) if sizes == [16] else digits(pick(sizes))  # noqa: B023, E731
        text, items, sep = pick(["", "call ", "pay with ", "table ", "numbers: "]), set(), pick([" ", " ", " ", "/", ", "])
        for k in range(rng.randint(2, 8) if kind else rng.randint(2, 24)):
            item = make()
            text += sep if k else ""
            if kind:
                items.add((kind, len(text), len(text) + len(item)))
            text += item
        out.append((text + pick([" now", ".", "", "\n"]), items))
    return out


def fit(n: int = 8000, seed: int = 11, precision: float = 0.99) -> tuple[Trees, dict[str, float]]:
    """(trees, threshold of each kind). A candidate is right if it is an item of its kind from end to end.

    Rows of numbers (n / 8 texts) come besides. Two thirds of the invented texts train the trees; on the rest, each kind's threshold is set midway into the
    probabilities, but never below the least one from which on the share of right candidates is `precision`.
    """
    import numpy as np

    import random

    rows, want, kinds, part, rng = [], [], [], [], random.Random(seed)
    for text, items in [*((t, {(kind, *place)}) for t, place, kind in examples(n, seed)), *lists(n // 8, seed + 1)]:
        held = rng.random() < 1 / 3
        for c in candidates(text):
            rows.append(features(text, c))
            want.append(float(c in items))
            kinds.append(c[0])
            part.append(held)
    x, y, kinds, held = np.array(rows), np.array(want), np.array(kinds), np.array(part)
    model, limits = Trees().fit(x[~held], y[~held]), {}
    for k in KINDS:
        mine = held & (kinds == k)
        p, right = model.predict(x[mine]), y[mine]
        order = np.argsort(-p, kind="stable")
        share = right[order].cumsum() / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= precision)
        limits[k] = max(0.5, float(p[order[good[-1]]])) if len(good) else 1.1
    return model, limits


def find(texts: list[bytes | None], model: Trees, limits: dict[str, float]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of all spans of each text by kind as in KINDS, then start.

    Base spans stay. Selected candidates are added in descending probability, then by place, as far as they touch no
    span that is there already.
    """
    import numpy as np

    decoded = [(t or b"").decode("utf-8", "surrogatepass") for t in texts]
    base, rows, of, selected = [base_spans(t) for t in decoded], [], [], []

    def judge() -> None:
        if rows:
            selected.extend((-q, i, c) for q, (i, c) in zip(model.predict(np.array(rows)).tolist(), of) if q >= limits[c[0]])
            rows.clear()
            of.clear()

    for i, (t, data) in enumerate(zip(decoded, texts)):
        taken = {(a, b) for _, a, b in base[i]}
        for c in candidates(t, data or b""):
            if c[1:] not in taken:
                rows.append(features(t, c))
                of.append((i, c))
                if len(rows) == JUDGED:
                    judge()
    judge()
    out = [[(*s, True) for s in b] for b in base]
    used: dict[int, bytearray] = {}
    for _, i, c in sorted(selected):
        if i not in used:
            used[i] = bytearray(len(decoded[i]))
            for _, a, b in base[i]:
                used[i][a:b] = b"\1" * (b - a)
        if used[i].find(1, c[1], c[2]) < 0:
            used[i][c[1] : c[2]] = b"\1" * (c[2] - c[1])
            out[i].append((*c, False))
    rank = {k: n for n, k in enumerate(KINDS)}
    return [sorted(s, key=lambda x: (rank[x[0]], x[1], x[2])) for s in out]


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans", model: tuple | None = None) -> DataFrame:
    """docs with the personal data of each whole text: kind, start, end (code points, end exclusive), base.

    Null and empty texts have none; equal texts have equal spans; an empty table stays empty. The trees are some 100 kB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit())

    def make():
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        names = ("kind", "start", "end", "base")
        return lambda texts: [pa.array([[dict(zip(names, s)) for s in spans] for spans in find(texts.cast(pa.binary()).to_pylist(), *shared.value)], kind)]

    return append(docs, [(out, SPANS)], text, make)


def redacted(text: str, spans: list[tuple]) -> str:
    """text with each span replaced by its kind in brackets, as [EMAIL]; overlapping spans are one, of the first one's kind."""
    parts, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", model: tuple | None = None) -> DataFrame:
    """docs with redacted texts, in one pass.

    Where docs has the column `length`, it gets the new number of characters of the texts that change; the other columns and their order stay.
    """
    shared, new, some = docs.sparkSession.sparkContext.broadcast(model or fit()), unused(docs, "redacted"), unused(docs, "n_spans")

    def make():
        import pyarrow as pa

        def apply(texts):
            data = texts.to_pylist()
            spans = find([t and t.encode("utf-8", "surrogatepass") for t in data], *shared.value)
            return [pa.array([redacted(t, s) if s else t for t, s in zip(data, spans)], pa.string()), pa.array([len(s) for s in spans], pa.int32())]

        return apply

    df, kinds = append(docs, [(new, "string"), (some, "int")], text, make), dict(docs.dtypes)

    def column(c: str):
        if c == text:
            return F.col(new).alias(c)
        if c == length:
            return F.when(F.col(some) > 0, F.length(new)).otherwise(F.col(f"`{c}`")).cast(kinds[c]).alias(c)
        return F.col(f"`{c}`")

    return df.select(*(column(c) for c in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts and digest of the base spans, and all spans."""
    df = with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    added = F.size("spans") - F.size(base)
    return df.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added.cast("long").alias("n_added"))

"""Secrets in texts: candidates by their shape, false ones removed by a random forest trained on labelled findings.

A candidate is a run of letters, digits, '-', '_', '+' and '/' (and '=' at its end) of at least MIN_LENGTH characters
with a digit, with a capital within, or with a known prefix of keys; and, of any length and characters, the quoted or
unbroken value that a key word (password, token, secret ...) is given. A run within a value that is found is not reported
beside it. The forest reads its length, its transitions between classes of characters and how likely its letters follow
each other in words, how much of it a dictionary covers, and what the path it came from, the words next to it and its own
first signs say: each such word, piece of a path and beginning counts for or against a secret as far as the labelled
findings have it more among secrets or among the others. The dictionary is the words of a public tokenizer's vocabulary,
or those of a table of one's own.

labelled_findings() makes the findings that the forest is trained on when no table of them is given: keys, tokens and
passwords in their usual surroundings, against numbers, identifiers, digests, paths and long words. A table of one's own
has the columns of FINDING and is read up to SAMPLE rows, chosen by hash. A forest of no findings removes nothing: every
candidate is reported with score 1.

A null text has no candidates. A null path is the empty path. A text's candidates are all reported, also repeated ones,
with their place; repeated rows of a document are reported again. The secret itself is not in the result, only its hash.
Null ids are reported as null. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._spark import pick, table
from treeline.llm._text import blocks, text_bytes
from treeline.llm._vocabulary import rank_file

MIN_LENGTH = 12
#: Bytes before and after a candidate that its neighbouring words are taken from.
NEAR = 40
SAMPLE = 20_000
#: A finding stays from this share of trees on.
KEEP = 0.5
TREES, DEPTH = 40, 10
FINDING = ("candidate", "before", "after", "path", "secret")

#: Words that labelled_findings() makes names and values of.
WORDS = frozenset(
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so "
    "what up its about into than them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through "
    "name file path user users data value index table code class function return string number object array list item node page view home src lib test tests main config build docs image images static assets "
    "version release license public private service server client request response error message content type text title date year month week day hour total count size width height color style script "
    "der die das und ist nicht von mit sich den ein eine als auch le la les des et une que qui dans pour par sur el los las de del por con para una".split()
)
KEYS = ("password", "passwd", "pwd", "secret", "token", "api", "apikey", "key", "auth", "bearer", "credential", "private", "access", "aws", "login")
PLAIN = ("commit", "sha", "md5", "checksum", "digest", "uuid", "id", "version", "isbn", "order", "phone", "card", "revision", "http", "https", "image", "hash", "ref")
_IN = np.zeros(256, bool)
_IN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"-_+/"]] = True
_CLS = np.zeros(256, np.uint8)
_CLS[97:123], _CLS[65:91], _CLS[48:58] = 1, 2, 3
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_VOWEL = np.zeros(256, bool)
_VOWEL[[*b"aeiouyAEIOUY"]] = True
_WORD = re.compile(rb"[A-Za-z]+")
_PIECE = re.compile(r"[a-z]+|[^a-z/.\\ ]+")
#: Findings that a word must be in to count, and the most that it counts.
LEAST_FINDINGS, MOST_WEIGHT = 5, 4.0
LONGEST_WORD = 14
FEATURES = 26

PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"xoxb", b"sk_l", b"AIza", b"glpa")
#: A key word before the '=', ':' or quote that a value follows; words of many other uses must stand alone.
_KEYWORD = re.compile(
    rb"(?:(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|credential)[\w.\-]{0,24}"
    rb"|(?:(?<![A-Za-z])(?i:key|auth|authorization|api|pass|aws|login|bearer)|(?<=[a-z0-9])(?:Key|Auth|Pass|Login)))[\"'\])]{0,2}[ \t]{0,3}$"
)
_VALUE = re.compile(rb"[=>]?[ \t]{0,3}(?:(?:(?i:bearer|basic)[ \t]{1,3})?)(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|`([^`\r\n]+)`|([^\s\"'`]+))")
_BEARER = re.compile(rb"(?:[Bb]earer|BEARER)[ \t]|--?[a-z\-]*(?:password|passwd|token|secret|key)[ \t]")
_PLACEHOLDER = re.compile(rb"[$<{%*\[(]|x+$|\.+$|-+$", re.I)
_NO_VALUE = frozenset(b"none null nil true false string str int integer bool boolean text value undefined optional required input varchar password passwd secret token key the a an is are and or this that your it to for not".split())


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of all candidates."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if not n:
        return z, z, z
    inside = _IN[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = edge.copy()
    change[1:n] |= inside[1:] != inside[:-1]
    change[n] = True
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    long = (end - start >= MIN_LENGTH) & inside[start]
    start, end = start[long], end[long]
    if not len(start):
        return z, z, z
    cls = _CLS[data]
    digits = np.concatenate([[0], np.cumsum(cls == 3)])
    capital = np.zeros(n + 1, np.int64)
    capital[2:] = np.cumsum((cls[1:] == 2) & (cls[:-1] == 1))
    some = (digits[end] > digits[start]) | (capital[end] > capital[start + 1])
    head = sum(data[start + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    some |= np.isin(head, [int.from_bytes(x, "little") for x in PREFIXES])
    start, end = start[some], end[some].copy()
    row = np.searchsorted(offsets, start, "right") - 1
    for _ in range(2):
        more = (end < offsets[row + 1]) & (data[np.minimum(end, n - 1)] == 61)
        end[more] += 1
    return row, start, end


def values(raw: bytes, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Row, start and end of the values of key words."""
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((data == 61) | (data == 58) | (data == 34) | (data == 39))
    rows = np.searchsorted(offsets, at, "right") - 1
    begin = []
    for r, p in zip(rows.tolist(), at.tolist()):
        quote = raw[p] in b"\"'"
        # A quote after a key word and a space opens its value; one without closes the word.
        if (not quote or raw[p - 1 : p] in (b" ", b"\t")) and _KEYWORD.search(raw, max(int(offsets[r]), p - 48), p):
            begin.append((r, p if quote else p + 1))
    for m in _BEARER.finditer(raw):
        r = int(np.searchsorted(offsets, m.start(), "right")) - 1
        if m.end() < offsets[r + 1]:
            begin.append((r, m.end()))
    out = set()
    for r, p in begin:
        m = _VALUE.match(raw, p, int(offsets[r + 1]))
        if m is None:
            continue
        s, e = m.span(m.lastindex)
        if m.lastindex == 4:
            other = re.search(rb"&[\w.\-]+=", raw[s:e])
            e = s + (other.start() if other else len(raw[s:e].rstrip(b",;.)]}")))
        if e > s:
            out.add((r, s, e))
    return sorted(out)


def dictionary_words(path: str | None = None) -> frozenset[bytes]:
    """Words of three letters or more in a vocabulary file, in lower case."""
    tokens = (base64.b64decode(line.split()[0]) for line in rank_file(path).splitlines() if line)
    return frozenset(t.lower() for t in (x.lstrip(b" ") for x in tokens) if 3 <= len(t) <= LONGEST_WORD and _WORD.fullmatch(t))


def signs(candidate: bytes, before: bytes, after: bytes, path: str) -> dict[str, list[tuple]]:
    """What next to a candidate and at its beginning speaks for or against it, by kind."""
    last, nxt = [w.lower() for w in _WORD.findall(before)[-3:]], [w.lower() for w in _WORD.findall(after)[:2]]
    return {"before": [("b", w) for w in last], "last": [("l", w) for w in last[-1:]], "after": [("a", w) for w in nxt], "path": [("p", x) for x in dict.fromkeys(_PIECE.findall(path.lower()))], "head": [("h", candidate[:4])]}


class Knowledge:
    """What features need beside a candidate: a dictionary, how its letters follow each other, and weights of signs."""

    def __init__(self, words: frozenset[bytes], findings: list[tuple]):
        self.words = words
        pairs = np.ones((27, 27))
        for w in words:
            x = [c - 96 for c in w] + [0]
            np.add.at(pairs, ([0, *x[:-1]], x), 1)
        self.follows = np.log(pairs / pairs.sum(1, keepdims=True))
        count: dict[tuple, list[int]] = {}
        total = [2, 2]
        for *f, secret in findings:
            total[bool(secret)] += 1
            for x in {x for xs in signs(*f).values() for x in xs}:
                count.setdefault(x, [1, 1])[bool(secret)] += 1
        self.weight = {x: float(np.clip(np.log(c[1] / total[1] * total[0] / c[0]), -MOST_WEIGHT, MOST_WEIGHT)) for x, c in count.items() if sum(c) - 2 >= LEAST_FINDINGS}

    def covered(self, candidate: bytes) -> int:
        """Letters that words of the dictionary cover, the longest first from the left."""
        low, words, i, n = candidate.lower(), self.words, 0, 0
        while i < len(low) - 2:
            for k in range(min(LONGEST_WORD, len(low) - i), 2, -1):
                if low[i : i + k] in words:
                    i, n = i + k, n + k
                    break
            else:
                i += 1
        return n

    def features(self, candidate: bytes, before: bytes, after: bytes, path: str) -> list[float]:
        b = np.frombuffer(candidate, np.uint8)
        n = len(b)
        c = _CLS[b]
        changes = int(np.count_nonzero(c[1:] != c[:-1]))
        counts = np.bincount(b, minlength=256)
        share = counts[counts > 0] / n
        entropy = float(-(share * np.log2(share)).sum())
        letters = (c == 1) | (c == 2)
        pairs = letters[1:] & letters[:-1]
        # Alternation of vowels and consonants as words have it, and how likely words are to have the pairs of letters.
        swaps = int(np.count_nonzero(pairs & (_VOWEL[b[1:]] != _VOWEL[b[:-1]])))
        low = (b | 32).astype(np.int64) - 96
        likely = float(self.follows[low[:-1][pairs], low[1:][pairs]].mean()) if pairs.any() else -6.0
        head = before.rstrip(b" \"'`")
        said = {k: sum(self.weight.get(x, 0.0) for x in xs) for k, xs in signs(candidate, before, after, path).items()}
        return [
            n, (c == 1).sum() / n, (c == 2).sum() / n, (c == 3).sum() / n, (c == 0).sum() / n,
            changes / n, entropy, entropy / np.log2(max(n, 2)), float(_HEX[b].all()), swaps / max(int(pairs.sum()), 1), len(share) / n, likely,
            self.covered(candidate) / n, candidate.count(b"/") / n, candidate.count(b"-") / n,
            said["before"], said["last"], said["after"], said["path"], said["head"],
            float(head[-1:] in (b"=", b":")), float(before[-1:] in (b'"', b"'")), float(after[:1] == before[-1:] and after[:1] in (b'"', b"'")), float(candidate.endswith(b"=")),
            float(_PLACEHOLDER.match(candidate) is not None), float(candidate.lower() in _NO_VALUE or b"(" in candidate or b" " in candidate),
        ]


class Tree:
    """A classification tree in arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int, rng):
        self.f, self.t, self.l, self.r, self.v = [], [], [], [], []
        self._grow(x, y, depth, rng)
        self.f, self.t, self.l, self.r, self.v = map(np.array, (self.f, self.t, self.l, self.r, self.v))

    def _grow(self, x, y, depth, rng) -> int:
        k = len(self.f)
        for a in (self.f, self.t, self.l, self.r):
            a.append(-1)
        self.v.append(float(y.mean()) if len(y) else 0.0)
        if depth == 0 or len(y) < 4 or y.min() == y.max():
            return k
        best = (1e-9, None, None)
        base = self.v[k] * (1 - self.v[k])
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            if len(at):
                left = np.cumsum(t)[at - 1]
                p, q = left / at, (t.sum() - left) / (len(t) - at)
                gain = base - (at * p * (1 - p) + (len(t) - at) * q * (1 - q)) / len(t)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], f, (v[at[i] - 1] + v[at[i]]) / 2)
        if best[1] is None:
            return k
        low = x[:, best[1]] <= best[2]
        self.f[k], self.t[k] = int(best[1]), float(best[2])
        self.l[k] = self._grow(x[low], y[low], depth - 1, rng)
        self.r[k] = self._grow(x[~low], y[~low], depth - 1, rng)
        return k

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.f[at] >= 0)).size:
            k = at[inner]
            at[inner] = np.where(x[inner, self.f[k]] <= self.t[k], self.l[k], self.r[k])
        return self.v[at]


class Forest:
    def __init__(self, findings: list[tuple], words: frozenset[bytes] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.knowledge = Knowledge(dictionary_words() if words is None else words, findings)
        self.features = self.knowledge.features
        x = np.array([self.features(*f[:4]) for f in findings]).reshape(len(findings), FEATURES)
        y = np.array([float(f[4]) for f in findings])
        self.trees = []
        for _ in range(trees if len(y) else 0):
            i = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(x[i], y[i], depth, rng))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if self.trees else np.ones(len(x))


def labelled_findings(n: int = 4000, seed: int = 5) -> list[tuple]:
    """n findings (candidate, before, after, path, secret), half of them secrets."""
    r = random.Random(seed)
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    pick_ = lambda s, k: "".join(r.choice(s) for _ in range(k))
    syllables = "er the an re on at en nd ti es or te ed is it al ar st to nt ng se ha ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur lich ung sch eau tion ment ció".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    paths = ("src/app/config.py", ".env", "deploy/settings.yml", "docs/readme.md", "tests/test_api.py", "web/index.html", "src3", "site12", "", "lib/util.js", "example/sample.txt")
    out = []
    for i in range(n):
        path = r.choice(paths)
        if i % 2:
            kind = r.randint(0, 10)
            key = r.choice(("token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "passwd"))
            sep, q = r.choice((" = ", "=", ": ", ":")), r.choice(('"', "'", ""))
            before, after = prose(3) + " " + key + sep + q, q + " " + prose(2)
            if kind == 0:
                c = pick_(hexes, r.choice((32, 40, 64)))
            elif kind == 1:
                c, before, after = r.choice(("AKIA", "ASIA")) + pick_(string.ascii_uppercase + "234567", 16), r.choice((prose(3) + " ", before)), r.choice((" " + prose(2), after))
            elif kind == 2:
                c, before, after = "ghp_" + pick_(alnum, 36), r.choice((prose(3) + " ", before)), r.choice((" " + prose(2), after))
            elif kind == 3:
                c = pick_(hexes, r.randint(12, 24))
            elif kind == 4:
                c = pick_(alnum, r.randint(16, 44))
            elif kind == 5:
                c, before = pick_(alnum + "+/", 40) + r.choice(("", "=", "==")), prose(2) + r.choice((" Authorization: Bearer ", " aws_secret_access_key = ", " key: "))
            elif kind == 7:
                c = pick_(alnum + "!@#$%^&*?.", r.randint(6, 20))
            elif kind == 8:
                # Chosen by people: words with digits or signs in place of letters or behind.
                c = word() + word() + pick_(string.digits, r.randint(1, 4)) + r.choice(("", "", "!", "x", "#", word()))
                c = r.choice((c, c.capitalize(), c.replace("a", "@").replace("o", "0"), c.replace("e", "3").capitalize() + r.choice("!@#?") + pick_(string.digits, 2)))
            elif kind == 9:
                c = pick_(r.choice((string.ascii_lowercase, string.ascii_uppercase)), r.randint(8, 32))
            else:
                c, before, after = r.choice(("sk_live_", "xoxb-", "AIza", "glpat-")) + pick_(alnum, 28), r.choice((prose(3) + " ", before)), " " + prose(2)
            out.append((c.encode(), before.encode()[-NEAR:], after.encode()[:NEAR], path, True))
        else:
            kind = r.randint(0, 11)
            before, after = prose(4) + " ", r.choice((" ", ". ", ", ")) + prose(3)
            if kind == 0:
                c = pick_(string.digits, r.choice((12, 13, 15, 16)))
            elif kind == 1:
                c = "-".join((pick_(hexes, 8), pick_(hexes, 4), pick_(hexes, 4), pick_(hexes, 4), pick_(hexes, 12)))
                before = prose(2) + r.choice((" id ", " uuid: ", " request "))
            elif kind == 2:
                c, before = pick_(hexes, r.choice((32, 40, 64))), prose(2) + r.choice((" commit ", " sha ", " md5: ", " checksum ", " revision ", " digest: "))
            elif kind == 3:
                c = "/".join(r.choice(("src", "lib", "users", "images", "static", "assets", word(), word())) for _ in range(r.randint(2, 6))) + "/" + pick_(string.digits, 4)
                before = prose(2) + r.choice((" http:/", " see ", ' href="'))
            elif kind == 4:
                c = "".join(word().capitalize() for _ in range(r.randint(2, 5))) + "X" + word() + word()
            elif kind == 5:
                c = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}"
            elif kind == 6:
                c = "_".join(r.choice(tuple(WORDS)) for _ in range(3)) + "_v" + str(r.randint(1, 99))
                before = prose(2) + r.choice((" ", " token ", " key "))
            elif kind == 7:
                c = "-".join((pick_(string.digits, 3), pick_(string.digits, 3), pick_(string.digits, 4), pick_(string.digits, 2)))
                before = prose(2) + r.choice((" phone ", " isbn ", " order ", " card "))
            elif kind == 8:
                c = r.choice(("Enter", "Your", "my", "example", "CHANGE")) + r.choice(("Password", "Token", "Secret", "ApiKey")) + r.choice(("Here", "Value123", "Example1", "123"))
                before = prose(2) + r.choice((" password = ", ' token: "', " key "))
            elif kind >= 10:
                # What key words are given that is no secret.
                key = r.choice(("token", "secret", "api_key", "password", "key", "auth", "login", "passwd"))
                c = r.choice((r.choice(sorted(WORDS)), r.choice(sorted(WORDS)), r.choice(sorted(x.decode() for x in _NO_VALUE)), "${" + key.upper() + "}", "<your-" + key + ">", "*" * r.randint(3, 12), "xxxxxxxx", "os.environ.get(" + key, "get_" + key + "()", prose(3), str(r.randint(0, 99))))
                sep, q = r.choice((" = ", "=", ": ", ":")), r.choice(('"', "'", "", ""))
                before, after = prose(3) + " " + key + sep + q, q + r.choice((" ", ", ", "\n")) + prose(2)
            else:
                c = "".join(word() for _ in range(5)) + str(r.randint(1, 99))
            out.append((c.encode(), before.encode()[-NEAR:], after.encode()[:NEAR], path, False))
    return out


def fit(findings: DataFrame | None = None, sample: int = SAMPLE, dictionary: DataFrame | None = None) -> Forest:
    """A forest of at most `sample` labelled findings. dictionary: (word) of a fixed list, which every worker holds."""
    words = None if dictionary is None else frozenset(r[0].lower().encode() for r in dictionary.select("word").where("word is not null").distinct().collect() if len(r[0]) > 2)
    if findings is None:
        return Forest(labelled_findings(), words)
    rows = findings.select(*FINDING).where("candidate is not null and secret is not null").orderBy(F.xxhash64("candidate", "before", "after")).limit(sample).collect()
    return Forest([((r[0]).encode(), (r[1] or "").encode()[-NEAR:], (r[2] or "").encode()[:NEAR], r[3] or "", r[4]) for r in rows], words)


def found(text: Column, path: Column, forest, keep: float = KEEP) -> Column:
    """Array of the findings in a text."""

    @F.arrow_udf("array<struct<start:bigint,length:int,score:double,digest:string>>")
    def of(column: pa.Array, paths: pa.Array) -> pa.Array:
        from hashlib import sha256

        data, offsets, _ = text_bytes(column)
        out: list[list] = [[] for _ in range(len(column))]
        for lo, hi in blocks(offsets):
            base = offsets[lo]
            part = data[base : offsets[hi]]
            row, start, end = candidates(part, offsets[lo : hi + 1] - base)
            x, raw = [], part.tobytes()
            given = values(raw, offsets[lo : hi + 1] - base)
            spans = sorted({*zip(row.tolist(), start.tolist(), end.tolist()), *given})
            if not spans:
                continue
            for r, s, e in spans:
                a, z = int(offsets[lo + r] - base), int(offsets[lo + r + 1] - base)
                x.append(forest.value.features(raw[s:e], raw[max(a, s - NEAR) : s], raw[e : min(z, e + NEAR)], paths[lo + r].as_py() or ""))
            score = forest.value.predict(np.array(x))
            known, whole = set(given), {}
            for (r, s, e), p in zip(spans, score.tolist()):
                if p >= keep and (r, s, e) in known:
                    whole.setdefault(r, []).append((s, e))
            for (r, s, e), p in zip(spans, score.tolist()):
                if any(a <= s and e <= z and (a, z) != (s, e) for a, z in whole.get(r, ())):
                    continue
                a = int(offsets[lo + r] - base)
                chars = int(np.count_nonzero(part[a:s] & 0xC0 != 0x80))
                out[lo + r].append({"start": chars, "length": e - s, "score": p, "digest": sha256(raw[s:e]).hexdigest()})
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("score", pa.float64()), ("digest", pa.string())])))

    return of(text, path)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", findings: DataFrame | None = None, keep: float = KEEP, dictionary: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, length, score, digest) of the findings that the forest takes for secrets; start counts characters."""
    forest = df.sparkSession.sparkContext.broadcast(fit(findings, dictionary=dictionary))
    docs = pick(df, id=id_col, text=text_col, path=path_col).select("id", "text", F.col("path").cast("string").alias("path"))
    each = docs.select(F.col("id").alias("doc_id"), F.explode(found(F.col("text"), F.col("path"), forest, keep)).alias("f")).select("doc_id", "f.*")
    return each.where(F.col("score") >= keep).withColumn("score", F.round("score", 6))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


SQL = None

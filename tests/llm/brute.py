"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORDS.findall(text or "")


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = ("assign", "access", "hex")
    joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return tuple(sum(s[1] == k for s in spans) for k in range(3)) + (hashlib.sha256(joined.encode()).hexdigest(), joined)


def targets(sizes, most=3):
    """source -> target, by sharing again and again; None last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(out.values())
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > most * sizes[s] + 1e-9]
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
    return out


def greedy_pieces(word, vocabulary, start=b" "):
    s, n = start + word, 0
    while s:
        size = next((k for k in range(len(s), 0, -1) if s[:k] in vocabulary), 0)
        if not size:
            return 1
        s, n = s[size:], n + 1
    return n


def line_dedup(docs, min_docs=3):
    """docs: (doc_id, text) -> (n_lines, n_dropped, kept) of each."""
    blanks = " \t\n\x0b\x0c\r"
    key = lambda x: lower(x.strip(blanks))
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                held[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or not (len(ids := held.get(key(x), ())) >= min_docs and i != max(ids))]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text):
    w = lower(text or "").split() if False else [lower(x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(docs, percent=85):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def quality_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def near_words(words):
    """word -> its near words: all that differ by one letter inserted, deleted or replaced."""
    out = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            if rest in out:
                out[w].add(rest)
                out[rest].add(w)
    open_at = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            open_at[w[:i], w[i + 1 :]].add(w)
    for group in open_at.values():
        for w in group:
            out[w] |= group - {w}
    return out


def spelling(docs, least_count=3):
    """docs: (doc_id, text) -> {word: (n, n_near, form, form_n, root)}."""
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text or "")):
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least_count}
    near = near_words(counts)
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda b: (-counts[b], b), default=None)
        forms[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {w: (n, len(near[w]), forms[w], counts.get(forms[w]), root(w)) for w, n in counts.items()}


def following(docs):
    """docs: (doc_id, text), ids distinct -> {doc_id: (n_chars, edited text, next text)}."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[i] = (len(text), text[: len(text) - half] + after[:half], after)
    return out


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def toxic_word(word, lexicon, second, lookalikes):
    """(tier as a whole word, tier by its beginnings, second person, obfuscated) of one word."""
    own = word.lower()
    while own and not own[0].isalnum():
        own = own[1:]
    while own and not own[-1].isalnum():
        own = own[:-1]
    plain = own if own.isalpha() else "".join(c for c in (lookalikes.get(c, c) for c in own) if c.isalnum() and not c.isdecimal())
    letter = lambda c: c.isalnum() and not c.isdecimal()
    odd = any(letter(a) and a == b == c for a, b, c in zip(word, word[1:], word[2:], strict=False))
    for i in range(1, len(word)):
        j = i
        while j < len(word) and (word[j].isdecimal() or word[j] in "@$*_#"):
            j += 1
        odd = odd or (j > i and j < len(word) and letter(word[i - 1]) and letter(word[j]))
    tier = lambda term: lexicon.get(term, (0,))[0]
    if len(plain) < 2:
        return 0, 0, own in second, odd
    return tier(f"={plain}"), max((tier(plain[:n]) for n in (4, 6) if len(plain) >= n), default=0), own in second, odd


def toxic_features(text, lexicon, second, lookalikes):
    said = words(text)
    found = [toxic_word(w, lexicon, second, lookalikes) for w in said]
    people = [i for i, f in enumerate(found) if f[2]]
    n, once = max(1, len(said)), dict(zip(said, found, strict=True))
    out = [math.log1p(len(said)), len(people) / n, sum(f[3] for f in found) / n]
    for kind in (0, 1):
        for k in (1, 2, 3):
            hits = [i for i, f in enumerate(found) if f[kind] >= k]
            near = [i for i in hits if any(abs(i - j) <= 4 for j in people)]
            out += [len(hits) / n, math.log1p(sum(f[kind] >= k for f in once.values())), len(near) / n]
    raw = (text or "").encode()
    upper, lower_, size = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw), max(1, len(raw))
    of = lambda kind: sum(b in kind for b in raw) / size
    return [*out, upper / max(1, upper + lower_), of(b"!?*#%&$@"), of(b"!?"), of(b"\n"), len(once) / n, (len(raw) - len(said)) / n]


def forest(model):
    """The trees of a fitted model as nested tuples (feature, threshold, left, right) or leaves, with their weights."""

    def node(x):
        if x.subtreeDepth() == 0:
            return x.prediction()
        return x.split().featureIndex(), x.split().threshold(), node(x.leftChild()), node(x.rightChild())

    return list(zip((node(t._java_obj.rootNode()) for t in model.trees), model.treeWeights, strict=True))


def toxic_score(features, trees, boundaries, predictions):
    margin = 0.0
    for tree, weight in trees:
        while isinstance(tree, tuple):
            tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
        margin += weight * tree
    raw = 1 / (1 + math.exp(-2 * margin))
    i = next((i for i, b in enumerate(boundaries) if b >= raw), len(boundaries))
    if i == len(boundaries) or boundaries[i] == raw or i == 0:
        curve = predictions[min(i, len(boundaries) - 1)]
    else:
        curve = predictions[i - 1] + (predictions[i] - predictions[i - 1]) * (raw - boundaries[i - 1]) / (boundaries[i] - boundaries[i - 1])
    return min(1.0, max(0.0, 0.99 * curve + 0.01 * raw))


def quality_tails(text, weights, thresholds, slots):
    """P(grade > j) of a text from hashed words and traits; `slots`: how many hashed features there are."""
    said = [w.encode() for w in words(text)]
    raw, total = (text or "").encode(), 0.0
    for w in set(said):
        low = w.lower()
        marks = bytes(sorted(b for b in set(low) if b in b"#*$%&|<>@=!?0"))
        total += sum(float(weights[xxhash.xxh32(x).intdigest() % slots]) for x in (b"w" + low, b"b" + low[:5], b"e" + low[-3:], b"s" + marks))
    total /= max(1, len(set(said))) ** 0.5
    n, size, lines = max(1, len(said)), max(1, len(raw)), raw.split(b"\n")
    upper, lower_, symbols = (sum(b in kind for b in raw) for kind in (range(65, 91), range(97, 123), b"#*$%&|<>"))
    degrees = [math.log2(n), 12 * len(set(said)) / n, 12 * upper / max(1, upper + lower_), 60 * symbols / size, 12 * (1 - len(set(lines)) / len(lines)), size / n]
    total += sum(float(weights[slots + 12 * i + min(11, int(x))]) for i, x in enumerate(degrees))
    return [1 / (1 + math.exp(-(total - t))) for t in thresholds]

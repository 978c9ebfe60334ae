"""Plain versions of the operators, for small inputs."""
import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def license_base(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def quality_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def shingles(text):
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(rows):
    """(doc_id, text) -> {doc_id: (shingles, least reachable doc_id)}."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def remove_repeats(texts, window):
    """Per text (n_bytes, n_removed, n_spans, kept)."""
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(r[s:s + window] for r in raws for s in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - window + 1):
            if count[r[s:s + window]] > 1:
                gone[s:s + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

"""Plain, slow versions of what the operators return, over Python rows."""

import base64
import collections
import hashlib
import re
import zlib

BLANK = " \t\n\x0b\x0c\r"
AWKWARD = [
    None, "", " ", "\n", "\n\n  \n", "a", "  a  b ", "one two", "Ein Ümlaut ß und é", "x" * 5_000, "word " * 30_000,
    "tab\tand\x0bmore\x0c\r\n", "▁ ▁▁literal ▁", "<s> </s> <|endoftext|>", "don't they'll I'VE 123 4567 !!! ...",
    "nul\x00inside", "emoji 😀 and 漢字 and Ελληνικά", "\u00a0\u2003wide blanks\u3000", "trailing   ", "\x1c\x1d odd \x85",
]


def lower(text):
    return text.encode().lower().decode()


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def in_fold(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def classes(size, links):
    """Least place reachable from each place."""
    root = list(range(size))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(size)]


def simhash(text, width=3):
    import xxhash

    found = words(text)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def line_key(line):
    return lower(line.strip(BLANK))


def dedup_lines(rows, min_chars=20, min_docs=3):
    """(lines before, positions dropped, text kept) per row (doc, text)."""
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [
            i for i, line in enumerate(lines)
            if doc is not None and len(holders.get(line_key(line), ())) >= min_docs and doc != max(holders[line_key(line)])
        ]
        out.append((len(lines), gone, "\n".join(line for i, line in enumerate(lines) if i not in set(gone))))
    return out


def shingles(text, width=5):
    found = words(text)
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def contained(docs, items, threshold=0.8):
    """(doc, item, shingles, shared) for rows (doc, text) and (item, text)."""
    out = []
    for item, text in items:
        own = min(5, len(words(text)))
        sets = shingles(text, own) if own else set()
        for doc, body in docs:
            shared = len(sets & shingles(body, own)) if own else 0
            if sets and shared >= threshold * len(sets) - 1e-9:
                out.append((doc, item, len(sets), shared))
    return sorted(out, key=repr)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL).groups()
    return lower(host), path


def url_verdict(url, rules):
    host, path = url_parts(url)
    fitting = []
    for verdict, rule in rules:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fitting.append((len(rule), rule, verdict))
    return (host, path, *(max(fitting)[1:] if fitting else (None, "allow")))


def tiktoken_encoding(path, pattern):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

"""Plain versions of the operators and small awkward tables."""

import base64

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use themselves.
CLASHES = "size long, target double, copies string, shard string, ids string, failed string, fp long, Findings int"


def awkward():
    """Nulls in every column, empty and blank texts, repeated rows and ids, a long text, ties."""
    long_text = " ".join(f"word{i} né{i % 7}" for i in range(20_000))
    rows = [
        (1, "a b c d", "en", "s1"),
        (1, "a b c d", "en", "s1"),
        (2, "a  b\tc d", None, "s1"),
        (3, None, "en", None),
        (4, "", "en", None),
        (5, " \n\t ", "de", "s2"),
        (None, "a b c d", "de", "s2"),
        (None, None, None, None),
        (6, long_text, "fr", "s1"),
        (7, "A B c D", "en", "s2"),
        (7, "other text with the id of another row", "en", "s3"),
        (8, "x", "en", "s3"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def docs(spark, rows=None, clashes=False):
    df = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    if clashes:
        for part in CLASHES.split(", "):
            name, kind = part.split()
            df = df.selectExpr("*", f"cast('7' as {kind}) as {name}")
    return df


def from_texts(spark, texts):
    return docs(spark, [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)])


def encoding():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_fingerprint(text, n=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [words[i : i + n] for i in range(len(words) - n + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps, bits=3):
    """Least position reachable over pairs within ``bits``, by comparing all pairs."""
    f = np.array(fps, dtype=np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

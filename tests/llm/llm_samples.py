"""Helpers of these tests."""

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"

# Names that the operators use inside, and names that need quoting.
CLASHES = [
    "digest", "unit", "bucket", "component", "score", "label", "row", "src", "id", "size", "class", "cell", "copies", "target",
    "pieces", "block", "guest", "row_key", "seeds", "found", "plain", "done", "hashes", "lines", "measure", "a.b", "x`y", "u", "v",
]



def sentence(rng, n, words=400):
    """``n`` words of an invented vocabulary."""
    return " ".join(f"w{rng.randrange(words):03d}" for _ in range(n))


def table(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

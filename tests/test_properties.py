import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docfathom.functions import text as T
from docfathom.sources import markdown, openapi


@given(st.text(alphabet="ab \n#\U0001f600é", max_size=400), st.integers(5, 40))
@settings(max_examples=200, deadline=None)
def test_packing_keeps_all_and_fits(source, size):
    parts = markdown.pack(source, size)
    assert all(0 < markdown.utf16(p) <= size for p in parts)
    whole = lambda x: re.sub("[\n\ufffd\U0001f600]", "", x)  # noqa: E731  a character cut in two is replaced
    assert whole("".join(parts)) == whole(source) and not re.search("[\ud800-\udfff]", "".join(parts))


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_slugs(text):
    s = T.slug(text)
    assert re.fullmatch(r"[a-z0-9]*(?:-[a-z0-9]+)*", s)
    assert T.slug(s) == s


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_queries_are_words_without_noise(query):
    for w in T.sanitize_query(query):
        assert w and not set(w) & set(T.QUERY_NOISE) and not any(c.isspace() for c in w)


@given(st.text(alphabet="abc#`>-* \n1.", max_size=300))
@settings(max_examples=300, deadline=None)
def test_headings_lie_in_the_source(source):
    last = 0
    for level, _, start, end in markdown.headings(source):
        assert 1 <= level <= 6 and last <= start <= end <= len(source)
        last = end
    for c in markdown.parse_markdown_text(source, "a", "/x/f.md"):
        assert c["content"] == markdown.trimmed(c["content"]) != ""


@given(st.dictionaries(st.text(min_size=1, max_size=3, alphabet="019ab-"), st.integers(), max_size=8))
@settings(max_examples=200, deadline=None)
def test_entries_put_whole_numbers_first(mapping):
    keys = [k for k, _ in openapi.entries(mapping)]
    number = [k for k in keys if k.isdigit() and str(int(k)) == k]
    assert keys[: len(number)] == sorted(number, key=int) and keys[len(number) :] == [k for k in mapping if k not in number]


def test_tokens_agree_with_the_column(spark):
    texts = ["Héllo wörld_x 42", "ÀÉÎ straße", "a-b/c {id}", "", "Ⅷ ½ ÆØ", "日本 語"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.tokens(df.t)).collect()]
    assert got == [T.token_list(t) for t in texts]


def test_batch_neighbours_equal_single_ones(spark):
    from docfathom.operators import vector

    rng = np.random.default_rng(0)
    rows = [(f"v{i}", rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)] + [("none", None)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(4)
    asked = [(i, rows[i][1]) for i in range(5)]
    batch = vector.search_batch(vectors, spark.createDataFrame(asked, "query_id long, vector array<float>"), 7).collect()
    for i, q in asked:
        one = [(r.id, r.distance) for r in vector.nearest(vectors, q, 7).collect()]
        assert [(r.id, r.distance) for r in sorted((r for r in batch if r.query_id == i), key=lambda r: r.vec_rank)] == one


def test_columns_split_and_pack_as_the_reader_does(spark):
    """By UTF-16 code units, also where a cut meets a character of two."""
    import random

    from docfathom.functions import text as T

    rng = random.Random(2)
    texts = ["", "a", "😀", "😀" * 9, "a" + "😀" * 9, "ab\n\n" + "é😀" * 7 + "\n\n\n\nx"]
    texts += ["".join(rng.choice(["a", "é", "😀", "𝐞", "\n\n", "漢"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def cut(t, size):
        raw = t.encode("utf-16-le")
        return [raw[i : i + 2 * size].decode("utf-16-le", "replace") for i in range(0, max(len(raw), 1), 2 * size)]

    for size in (1, 2, 7, 10):
        got = df.select("t", T.hard_split(df.t, size), T.pack_paragraphs(df.t, size), T.utf16_length(df.t)).collect()
        for t, pieces, packed, n in got:
            assert pieces == cut(t, size) and n == len(t.encode("utf-16-le")) // 2
            assert packed == markdown.pack(t, size), (t, size)

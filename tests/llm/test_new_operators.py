"""Language identification, tokenizer alignment and fill-in-middle against plain versions, and over odd and empty tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import alignment, fill_middle, language_id, queries
from tessera.llm.textbytes import Texts
from tests.compare import difference

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def code_lengths(rows, langs, held_out=2, order=4):
    """Bits of each (id, text, lang) by each language's counts of contexts, without exclusion."""
    trees = {lang: defaultdict(Counter) for lang in langs}
    for i, text, lang in rows:
        if text is not None and lang is not None and (i is None or fold(i) != held_out):
            b = b"\xff" * order + text.encode()
            for at in range(order, len(b)):
                for k in range(order + 1):
                    trees[lang][b[at - k:at]][b[at]] += 1

    def bits(tree, context, byte):
        seen = tree.get(context)
        below = (lambda: bits(tree, context[1:], byte)) if context else (lambda: 8.0)
        if not seen:
            return below()
        whole = sum(seen.values()) + len(seen)
        return math.log2(whole / seen[byte]) if byte in seen else math.log2(whole / len(seen)) + below()

    out = []
    for _, text, _ in rows:
        b = b"\xff" * order + (text or "").encode()
        out.append({lang: sum(bits(trees[lang], b[at - order:at], b[at]) for at in range(order, len(b))) for lang in langs})
    return out


@pytest.mark.parametrize("sent", [1 << 20, 50])
def test_code_lengths_are_those_of_context_trees(spark, sf, odd_docs, sent):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 900").select("doc_id", "text", "lang")
    docs = docs.union(odd_docs.filter("length(text) < 5000 or text is null").select("doc_id", "text", F_lang()))
    rows = [tuple(r) for r in docs.collect()]
    langs = sorted({r[2] for r in rows if r[2] is not None})
    want = sorted(((i if i is not None else -1, tuple(round(b[x], 2) for x in langs)) for (i, _, _), b in zip(rows, code_lengths(rows, langs))))
    found = language_id.languages(docs, sent=sent).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, tuple(round(r.bits[x], 2) for x in langs)) for r in found)
    assert len(got) == len(want)
    for (a, x), (b, y) in zip(got, want):
        assert a == b and np.allclose(x, y, atol=0.05)
    texts = defaultdict(list)
    for i, text, _ in rows:
        texts[i].append(text)
    for r in found:
        lettered = any(t and any(c.isalpha() for c in t) for t in texts[r.doc_id])
        assert 0 <= r.score <= 1 and (lettered or (r.lang_pred, r.score) == ("und", 0.0))


def F_lang():
    from pyspark.sql import functions as F

    return F.when(F.col("doc_id") % 2 == 0, F.lit("en")).alias("lang")


def test_languages_held_out_and_empty(spark, sf, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = queries.op11_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(true) and len(held) > 100 and all(r.held_out == (fold(r.doc_id) == 2) for r in found)
    assert sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) > 0.97
    assert language_id.languages(no_docs).count() == 0
    unlearned = spark.createDataFrame([(1, "some text", None), (None, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.languages(unlearned).collect()} == {("und", 0.0)}


def plain_alignment(rows):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)]: whole texts encoded at once, groups by a walk over bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    ranks = {int(k): base64.b64decode(t) for t, k in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}

    def piece(k):
        p = b.id_to_piece(k)
        m = re.fullmatch("<0x(..)>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    cut = []
    for _, text in rows:
        raw = (" " + (text or "")).encode()
        spans = []
        for ids, of in ((a.encode(" " + (text or ""), add_special_tokens=False).ids, ranks.__getitem__), (b.encode(text or ""), piece)):
            at, some = 0, []
            for k in ids:
                some.append((k, at, at + len(of(k))))
                at = some[-1][2]
            spans.append(some if b"".join(of(k) for k in ids) == raw else None)
        cut.append(None if not text or None in spans else spans)
    counts = Counter()
    links = []
    for spans in cut:
        linked = [] if spans is None else [(x, y) for x, p, q in spans[0] for y, r, s in spans[1][max(0, p - 400):] + spans[1][:max(0, p - 400)] if r < q and p < s]
        links.append(linked)
        counts.update(set(linked))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), spans, linked in zip(rows, cut, links):
        if spans is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = ["|".join(",".join(str(k) for k, _, e in some if lo < e <= hi) for some in spans) for lo, hi in zip([-1, *ends], ends)]
        out.append((i, len(spans[0]), len(spans[1]), len(groups), len(linked), sum(counts[x] == best[x[0]] for x in linked), sum(counts[x] for x in linked), ";".join(groups)))
    return out


ODD = ["", None, " ", "  two  spaces ", "tab\tand\nlines\r\n  x ", "a ▁ b", "<s> <|endoftext|> <0x41> </s>", "naïve café é x 　y z", "日本語 テキスト", "🙂 👩‍👩‍👧 ok", "\x00\x01\x1c x\x1d y", "it's we'll  I'm 12345 3.14 ", "x" * 700, "é " * 90, "word " * 60]


@pytest.mark.parametrize("size,sent", [(1 << 15, 1 << 20), (16, 40), (64, 1 << 20)])
def test_alignment_is_that_of_whole_texts(spark, sf, size, sent):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 500").limit(25)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(1000, "it's we'll  I'm 12345 3.14 "), (None, "x y")]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = alignment.align(made, *PATHS, size=size, sent=sent)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_alignment(rows), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n\t  .'ß日▁  \x1c1", max_size=60), st.integers(1, 40))
def test_segments_are_where_both_tokenizers_can_be_cut(text, size):
    pair, raw = alignment.pair_of(*PATHS), (" " + text).encode()
    b = np.frombuffer(raw, np.uint8)
    starts = alignment.segment_starts(b, np.zeros(1, np.int64))
    whole, parts = pair.tokens(raw), [pair.tokens(raw[i:j]) for i, j in zip(starts, [*starts[1:], len(raw)])]
    if text:
        assert (whole is None) == (None in parts)
    if whole is not None and text:
        assert all(np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist() for k in (0, 2))
        tokens = alignment.Open(*whole)
        pieces = []
        for low in range(0, len(raw), size):
            inside = [x[(e > low) & (e <= low + size)] for x, e in ((whole[0], whole[1]), (whole[1], whole[1]), (whole[2], whole[3]), (whole[3], whole[3]))]
            pieces.append(alignment.Fragment.of(alignment.Open(*inside), pair))
        left = pieces[0]
        for x in pieces[1:]:
            left = left.then(x, pair)
        right = pieces[-1]
        for x in reversed(pieces[:-1]):
            right = x.then(right, pair)
        at_once = alignment.Fragment.of(tokens, pair).whole(pair)
        for made in (left.whole(pair), right.whole(pair)):
            assert made.groups == at_once.groups and made.names.tolist() == at_once.names.tolist() and made.times.tolist() == at_once.times.tolist()


def test_alignment_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    found = alignment.align(odd_docs, *PATHS)
    assert found.count() == odd_docs.count() and alignment.align(no_docs, *PATHS).count() == 0
    zero = {r.doc_id for r in found.filter("n_a = 0").collect()}
    assert zero == {3, 4} and found.filter("n_a = 0 and (groups <> '' or n_links > 0)").count() == 0


def plain_cut(i, text, seed=42, rate=50, spm=80):
    units = UNIT.findall(text or "")
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, len(units), "plain", None, None, text or ""
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, len(units), form, len(prefix), len(middle), out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aé日🙂 \n\t<P>\x0b ", max_size=700), min_size=1, max_size=5), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_are_those_of_the_units(texts, first, second):
    h = [np.full(len(texts), x) for x in (first, second)]
    n, a, b, before, upto = fill_middle.cuts(Texts(pa.array(texts)), *h)
    for k, text in enumerate(texts):
        units = UNIT.findall(text)
        low, high = sorted((first % (len(units) + 1), second % (len(units) + 1)))
        start, stop = "".join(units[:low]), "".join(units[:high])
        assert (n[k], a[k], b[k], before[k], upto[k]) == (len(units), len(start.encode()), len(stop.encode()), len(start), len(stop))


def test_fill_in_middle_is_that_of_plain_cuts(spark, sf, odd_docs, no_docs):
    from pyspark.sql import functions as F

    more = [(50 + k, t) for k, t in enumerate(["a<P>b", "x <S", "< <M> y", "<", "one", " ", "\n\n", "é" * 1000, "a " * 3000, "<P", "P> b c d"])]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    for seed, rate in ((42, 50), (7, 100), (8, 100)):
        found = fill_middle.fill_in_middle(docs, seed, rate).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert sorted((tuple(r)[:-1] for r in found), key=repr) == sorted((plain_cut(r.doc_id, r.text, seed, rate) for r in docs.collect()), key=repr)
        assert sorted(r.back for r in found) == sorted(r.text or "" for r in docs.collect())
    assert fill_middle.fill_in_middle(no_docs).count() == 0
    assert difference(queries.op13_fill_in_middle(spark, sf), queries.ORACLE_SQL["op13_fill_in_middle"], sf) == ""

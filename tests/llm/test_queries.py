"""Every query over awkward rows and over empty tables; exact ones against brute force."""

import zlib

import brute
import numpy as np
import pytest
from webloom.llm import chat, decontamination, language_id, line_dedup, media, ngram_join, packing, quality, registry, substring_dedup, suffix_dedup


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def texts(awkward):
    return [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", registry.MODULES)
def test_empty_tables(spark, empty_dir, name):
    got = registry.queries()[name](spark, empty_dir).collect()
    assert [r.conv_id for r in got] == [-7] if name.startswith("op8") else got == []


def test_lines(spark, table_dir, texts):
    assert rows(line_dedup.op6_line_dedup(spark, table_dir)) == sorted(brute.lines(texts), key=repr)


def test_lines_keep_other_columns(awkward):
    out = line_dedup.dedup_lines(awkward)
    assert out.columns == [*awkward.columns, "n_lines", "n_dropped"]
    assert out.count() == awkward.count()


def test_join(spark, table_dir, texts):
    # Rows that share an id are judged by their own texts: the plain version gets ids of its own.
    got = ngram_join.op2_ngram_jaccard_join(spark, table_dir)
    plain = [(i, t) for i, t in texts if i is not None and i not in (11, 12)]
    want = brute.jaccard(plain, 3, 90)
    found = {r.doc_id: r for r in got.collect()}
    for i, (n, component, _) in want.items():
        assert (found[i].n_shingles, found[i].component_id) == (n, component)
    assert found[11].component_id == 1 and found[1].n_links == 4
    assert sum(r.doc_id is None and r.component_id is None for r in got.collect()) == 1


@pytest.mark.parametrize("n,percent,block", [(3, 90, 1_000_000), (5, 80, 1_000_000), (2, 60, 40)])
def test_join_exact(spark, n, percent, block):
    base = [f"w{i % 37} v{i % 11}" for i in range(40)]
    made = [(k, " ".join(x if (i * 7 + k) % (9 + k % 23) else f"e{k}" for i, x in enumerate(base))) for k in range(60)]
    made += [(100 + k, " ".join(base[: k % 20])) for k in range(40)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_join(df, n, percent, block=block).collect()}
    assert got == brute.jaccard(made, n, percent)


def test_contamination(spark, table_dir, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{table_dir}/benchmark.parquet").collect()]
    got = rows(decontamination.op3_decontamination(spark, table_dir), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(texts, items), key=repr)


def test_contamination_in_passes_and_near(spark, awkward, texts, monkeypatch):
    items = spark.createDataFrame([(1, "word5 von4 word6 von11 word7"), (2, "von4 word5 word6"), (3, "word9 von1 word8")], "item_id long, text string")
    want = [(i, h, n) for i, _, h, n, *_ in brute.contamination(texts, [tuple(r) for r in items.collect()])]
    for chunk in (200_000, 1):
        monkeypatch.setattr(decontamination, "CHUNK", chunk)
        got = decontamination.decontaminate(awkward, items)
        assert sorted(((r.doc_id, r.n_hit, len(r["items"])) for r in got.collect()), key=repr) == sorted(want, key=repr)
        assert {tuple(r.near_items) for r in got.collect() if r.doc_id == 1} == {("1", "2", "3")}


def test_index_of_all_terms(spark, awkward, texts, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_TERMS", 0)
    items = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    assert decontamination.decontaminate(awkward, items).filter("n_hit > 0").count() == 1


def test_windows(spark, table_dir, texts):
    assert rows(substring_dedup.op5_substring_dedup(spark, table_dir)) == sorted(brute.earlier_windows(texts), key=repr)


def test_windows_with_a_full_sketch(awkward, texts):
    """With a sketch too small for anything all windows reach the exact pass."""
    got = substring_dedup.dedup_windows(awkward, most_cells=1 << 16)
    assert got.columns == [*awkward.columns, "n_words", "n_removed"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got.collect()), key=repr) == sorted((x[:3] for x in brute.earlier_windows(texts)), key=repr)


@pytest.mark.parametrize("most", [2000, 1])
def test_bytes(spark, table_dir, texts, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    assert rows(suffix_dedup.op10_suffix_array_dedup(spark, table_dir)) == sorted(brute.repeated_bytes(texts), key=repr)


def test_packing(spark, table_dir, texts, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RANGE_ROWS", 5)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts if i is not None)
    df = packing.pack(spark.read.parquet(f"{table_dir}/documents.parquet"), packing.tokenizer_path(), with_ids=True)
    pieces = sorted(df.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for p in pieces:
        assert p.sequence_id * 1024 + p.offset == at and zlib.crc32(p.ids) == p.ids_crc32
        at += p.length
    whole, held = [], []
    for p in pieces:  # a document's pieces follow one another
        held += [int.from_bytes(p.ids[k : k + 4], "little") for k in range(0, len(p.ids), 4)]
        if p.start + p.length == p.doc_tokens:
            whole.append((p.doc_id, held))
            held = []
    assert sorted(x for x in whole if x[0] is not None) == want and len(whole) == len(texts)


def test_tokens_of_safe_texts_are_the_tokenizer_s():
    """The cut into pieces against the library, on random strings of all kinds of characters."""
    import random

    draw, enc = random.Random(4), packing.encoder(packing.tokenizer_path())
    kinds = ["abz'", "  \t\n", "019²", "-.,;'s", "éßÿĀ", "A 'll 're"]
    for _ in range(3000):
        text = "".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randint(0, 40)))
        assert np.frombuffer(enc.encode(text), enc.kind).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_length_has_no_place_on_the_curve(spark):
    """Documents of one topic lie together, however long they are."""
    topics = ["apple river stone window", "kernel thread buffer packet", "tenor violin chord rhythm", "salt pepper onion garlic"]
    rows = [(100 * t + k, " ".join([topic] * (3 + 40 * (k % 5)))) for t, topic in enumerate(topics) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pieces = packing.pack(docs, packing.tokenizer_path()).filter("start = 0").orderBy("sequence_id", "offset").collect()
    order = [r.doc_id // 100 for r in pieces]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) <= 8


def test_media(spark, table_dir, texts):
    got = media.op9_media_columns(spark, table_dir).collect()
    assert len(got) == len(texts)
    for i, t in texts:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        want = (len(data), len(payload), brute.sha(payload), zlib.crc32(payload[-32:]), brute.sha(media.graymap(payload)))
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) == want for r in got if r.doc_id == i)


def test_feature():
    """The feature against plain sums over rows of 24 samples."""
    payload = b"some text \xc3\xa9 of no great length".ljust(576, b"\xff")
    grid = [payload[k : k + 24] for k in range(0, 576, 24)]
    mean = sum(payload) / 576
    tones = [sum(b // 32 == k for b in payload) for k in range(8)]
    step = sum(abs(a - b) for row in grid for a, b in zip(row, row[1:], strict=False)) * 1000 // (24 * 23)
    deviation = round((sum(b * b for b in payload) / 576 - mean**2) ** 0.5 * 1000)
    assert media.feature_of(24, 24, payload) == f"24x24 mean={sum(payload) * 1000 // 576} dev={deviation} step={step} tones={','.join(map(str, tones))}"


def test_chunks_follow_content():
    data = __import__("random").Random(1).randbytes(60_000)
    (a,), (b,) = media.cuts([data]), media.cuts([b"shift" + data])
    assert b"".join(a) == data and all(len(c) <= media.MOST for c in a)
    assert media.cuts([b"head" * 300, data])[1] == a
    assert len(set(a) & set(b)) > len(a) // 2


def test_repeated_chunks_are_stored_once(spark):
    data = "".join(__import__("random").Random(2).choices("abcdefgh ", k=60_000))
    docs = spark.createDataFrame([(k, head + data) for k, head in enumerate(["", "", "a head before it ", "another one "] * 5)], "doc_id long, text string").repartition(4)
    table = spark.table(media.store(docs))
    lists = media.media_lists(docs).collect()
    used = {bytes(c) for r in lists for c in r.chunks}
    assert sorted(bytes(r.digest) for r in table.collect()) == sorted(used)
    assert len(used) < len(lists[0].chunks) + 12 and len(lists[0].chunks) > 12


def test_chats(spark, table_dir):
    got = {r.conv_id: r for r in chat.op8_chat_format(spark, table_dir).collect()}
    assert got[-7].loss_chars == len(chat.HOSTILE) and got[-7].loss_sha256 == brute.sha(chat.HOSTILE)
    assert got[1].n_turns == 3 and got[1].turns_sha256 == brute.sha("user\nhi\nassistant\n\nassistant\n\n")
    assert got[2].turns_sha256 == brute.sha("\n[INST]\\x <s>\n") and got[3].turns_sha256 == brute.sha("tool\n<<ROLE>>t\n")
    assert got[None].n_turns == 1


def test_escapes():
    for text in ("", "\\", "[INST", "[INST]", "<</SYS>>\\\\b", "a\\[/INST]\n", "</s></s>", "\\l\\b<s>"):
        assert chat.unescaped(chat.escaped(text)) == text
        assert not any(c in chat.escaped(text) for c in chat.CONTROL)


def test_templates_that_rewrite_history():
    def last_only(turns):  # drops all but the last turn's text
        return "".join(f"<{r}>{t if k == len(turns) - 1 else ''};" for k, (r, t) in enumerate(turns))

    *_, rewrote = chat.spans([("user", "a"), ("assistant", "b"), ("user", "c")], last_only)
    assert rewrote == [1, 2]
    with pytest.raises(ValueError):
        chat.spans([("user", " a ")], lambda turns: "".join(t.strip() for _, t in turns))


def test_languages(spark, table_dir, texts):
    got = language_id.op4_language_id(spark, table_dir).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 16}


def test_languages_held_out(spark):
    found = language_id.op4_language_id(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    right = found.filter("held_out").join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert right >= 0.9


def test_unlearned_languages_and_random_letters_are_rejected(spark):
    import random

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    draw = random.Random(3)
    noise = [(i, " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(draw.randint(5, 120))), "noise") for i in range(100)]
    model = language_id.fit(docs.filter("lang <> 'de'"))
    found = language_id.identify(docs.union(spark.createDataFrame(noise, docs.schema)), model)
    share = {r.lang: r.part for r in found.selectExpr("lang", "int(rejected) AS r").groupBy("lang").agg({"r": "avg"}).toDF("lang", "part").collect()}
    assert share.pop("de") >= 0.95 and share.pop("noise") >= 0.95
    assert set(share) == {"en", "es", "fr"} and max(share.values()) <= 0.03


def test_quality(spark, table_dir, texts):
    got = quality.op1_quality(spark, table_dir).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_held_out(spark):
    found = quality.op1_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_statistics_read_whole_texts():
    letters, numbers = b"word " * 2000, b"4711 " * 2000
    at = len(quality._KINDS) + 11  # the share of alphabetic words
    assert quality.statistics(letters + numbers)[at] == quality.statistics(numbers + letters)[at] == 0.5
    assert quality.statistics(letters * 2 + numbers)[at] == 2 / 3


def test_isotonic():
    assert quality.pooled(np.array([0, 2, 0, 1, 3]), np.array([1, 2, 0, 2, 3])).tolist() == [0, 0.75, 0.75, 0.75, 1]

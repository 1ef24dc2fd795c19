"""Source mix, URL filter, chat format and quality rules: SQL on the small tables, and the defined cases."""

import datetime as dt

import pytest

from kinweave.llm import chat_format, quality_rules, registry, source_mix, url_filter

DOCS = "doc_id long, text string, source string, h string, size int, n_words int, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, "y") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", ["op1_source_mix", "op5_url_filter", "op7_chat_format", "op9_quality_rules"])
def test_small_tables_give_the_oracle_rows(name, same_rows):
    same_rows(registry.queries()[name], registry.oracle_sql()[name])


def test_mix_keeps_every_row_and_comes_near_its_targets(spark):
    rows = [(i, "word " * (1 + i % 7), ("a", "b", None)[i % 3]) for i in range(300)] + [(7, "again", "a"), (None, None, "b"), (1000, "", "c")]
    out = source_mix.mix(docs(spark, rows)).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 2 * out["size"]).all()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    assert out.groupby("source", dropna=False)["target"].first().sum() == pytest.approx(1.5 * out["size"].sum())
    mixed = source_mix.mixed(docs(spark, rows))
    assert mixed.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert mixed.count() == out["repeats"].sum()


def test_mix_of_a_source_without_ids_comes_near_its_target(spark):
    rows = [(None, f"word number {k}", "a") for k in range(400)] + [(k, "one two", "b") for k in range(100)]
    out = source_mix.mix(docs(spark, rows)).toPandas()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 3


def test_targets_equal_repeated_resharing(spark):
    sizes = {"a": 700, "b": 20, "c": 300, "d": 5, None: 90}
    got = {r["source"]: r["target"] for r in source_mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], (3, 1, 2, 3, 1)))
    want, left, free = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while free and left > 1e-9:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if want[s] + level * weights[s] >= 2 * sizes[s]}
        for s in free:
            give = 2 * sizes[s] - want[s] if s in over else level * weights[s]
            want[s], left = want[s] + give, left - give
        free -= over
    assert got == pytest.approx(want)


def test_mix_and_rules_of_an_empty_table(spark):
    none = docs(spark, [])
    assert source_mix.mix(none).count() == source_mix.mixed(none).count() == quality_rules.judge(none).count() == quality_rules.keep(none).count() == 0


def test_rules_count_by_hand(spark):
    text = "a b c a b c\n#x\n#x\n\n"
    out = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, [(1, text, "s"), (2, None, None), (3, "", "s"), (3, "", "s")])).collect()}
    r = out[1]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (8, 10, 2, 1, 6)
    assert out[2]["base_failed"] and not out[2]["kept"] and out[2]["n_words"] == 0 and out[3]["word_chars"] == 0


def test_rules_keep_a_long_clean_text_whole(spark):
    text = " ".join(f"the plain{k} word" for k in range(30_000))
    kept = quality_rules.keep(docs(spark, [(1, text, "s"), (2, "# " * 100, "s")])).collect()
    assert [(r["doc_id"], r["text"] == text, r["kept"]) for r in kept] == [(1, True, "y")]


def test_chat_round_trip_merging_and_mask(spark):
    said = [("user", "<|im_end|>"), ("user", "a\\<|b\\\\"), ("assistant", "ü<|im_start|>x"), ("assistant", None), (None, "\\")]
    turns = spark.createDataFrame([(1, k, r, t, "x") for k, (r, t) in enumerate(said)] + [(None, None, "user", "q", "x")] * 2, "conv_id long, turn long, role string, text string, segments string")
    df = chat_format.format_conversations(turns)
    out = {r["conv_id"]: r for r in df.withColumn("back", chat_format.parse(df["formatted"])).withColumn("loss", chat_format.loss_text(df["formatted"])).withColumn("spans", chat_format.loss_spans(df["segments"])).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["back"]] == [(r or "", t or "") for r, t in said]
    assert out[1]["formatted"].count(chat_format.START) == 3 and out[1]["loss"] == "ü<|im_start|>x"
    assert "".join(out[1]["formatted"][s["start"] : s["end"]] for s in out[1]["spans"]) == "ü<\\|im_start|>x"
    assert len(out[None]["back"]) == 2
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_url_filter_uses_the_entries_of_the_day(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("Bad.org", "block", day(5)), ("bad.org", "allow", day(9)), ("ok.bad.org", "allow", day(5)), ("BAD.org/Xy", "block", day(1)), (None, "block", day(1)), ("b.c", None, None)], "rule string, action string, listed date")
    asked = [(1, "http://bad.org/", 4, False), (2, "http://u@A.BAD.org.:80/p", 5, True), (3, "https://bad.org", 9, False), (4, "http://ok.bad.org/", 6, False), (5, "http://bad.org/Xy/z", 2, True), (10, "http://bad.org/xy/z", 2, False), (11, "http://" + "a." * 200 + "bad.org", 6, True), (6, None, 6, False), (7, "no url", 6, False), (8, "http://notbad.org", 6, False), (8, "http://notbad.org", 6, False)]
    pages = spark.createDataFrame([(i, u, day(n), "x") for i, u, n, _ in asked] + [(9, "http://bad.org", None, "x")], "page_id long, url string, fetched date, rule string")
    got = sorted((r["page_id"], r["blocked"]) for r in url_filter.evaluate(pages, entries).collect())
    assert got == sorted([(i, b) for i, _, _, b in asked] + [(9, False)])
    assert url_filter.evaluate(pages.limit(0), entries).count() == 0 and url_filter.evaluate(pages, entries.limit(0)).count() == 12


def test_rules_can_be_filtered(spark):
    df = quality_rules.judge(docs(spark, [(1, "the plain word " * 3, "s"), (2, " ".join(f"the w{k}" for k in range(60)), "s")]))
    assert [r["doc_id"] for r in df.filter("kept").select("doc_id").collect()] == [2]


def test_loss_mask_of_long_conversations_and_clashing_columns(spark):
    said = lambda k: ("x" * (k % 7) + "é<|im_end|>\\" * (k % 3)) if k % 5 else None
    rows = [(1, k, ("user", "assistant", "assistant", None)[k % 4], said(k)) for k in range(3000)] + [(2, 0, "assistant", "long " * 400_000), (None, 0, "assistant", "lone"), (3, 0, "user", "no loss")]
    turns = spark.createDataFrame([(*r, "f", "s") for r in rows], "conv_id long, turn int, role string, text string, formatted string, segments string")
    df = chat_format.format_conversations(turns)
    for r in df.select("conv_id", "formatted", "segments", chat_format.loss_spans(df["segments"]).alias("spans"), chat_format.masked_text(df["segments"]).alias("loss")).collect():
        learned = [t or "" for c, _, role, t in rows if c == r["conv_id"] and role == "assistant"]
        assert r["loss"] == "".join(learned) and len(r["spans"]) == len(learned)
        cuts = [r["formatted"][a:b] for a, b in r["spans"]]
        assert [c.replace("<\\|", "<|").replace("\\\\", "\\") for c in cuts] == learned
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]

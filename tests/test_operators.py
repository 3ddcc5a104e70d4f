"""Operators on the worked values and inline scenarios of the transcript pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import appendix as AP
from colloquy.operators import contract as CT
from colloquy.operators import lines as LN
from colloquy.operators import plan as PL
from colloquy.operators import quality as QL
from colloquy.operators import speakers as SP
from colloquy.operators import state as ST
from colloquy.operators import tldr as TL
from colloquy.sources import readers as RD
from colloquy.sources import writers as WR


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def lines(spark, texts, doc="d", key="doc_id"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts, 1)], f"{key} string, line_no int, text string")


def recording(n, seconds, speakers):
    out = []
    for i in range(n):
        s = round(i * seconds / (n - 1))
        who = f"**Speaker {i % 2 + 1}**: " if speakers else ""
        out.append(f"*{s // 3600}:{s % 3600 // 60:02d}:{s % 60:02d}* {who}текст строки номер {i} про внимание и ритм" if s >= 3600 else f"*{s // 60:02d}:{s % 60:02d}* {who}текст строки номер {i} про внимание и ритм")
    return out


@pytest.mark.parametrize(("n", "seconds", "speakers", "chunks", "stage", "mode"), [(75, 350, False, 1, "skip", "monologue"), (643, 1920, False, 3, "skip", "monologue"), (3221, 5700, True, 5, "required", "conversation")])
def test_plan_of_recordings(spark, n, seconds, speakers, chunks, stage, mode):
    own = lines(spark, recording(n, seconds, speakers))
    meta = LN.file_meta(own).withColumn("work_id", F.lit("w"))
    work = PL.classified(meta).first()
    assert (work["speaker_stage"], work["duration_seconds"]) == (stage, seconds)
    assert work["content_mode"] == mode or speakers
    plan = PL.planned(meta, own).orderBy("extraction_start").collect()
    assert len(plan) == chunks
    assert [p["extraction_start"] for p in plan][0] == 1 and plan[-1]["extraction_end"] == n
    assert all(a["extraction_end"] + 1 == b["extraction_start"] for a, b in zip(plan, plan[1:]))
    assert plan[0]["context_start"] is None and all(len(p["chunk_fingerprint"]) == 12 for p in plan)


def test_chunk_formula_values(spark):
    cases = [(250, 1), (499, 2), (500, 2), (8000, 8), (12000, 9), (20000, 11)]
    df = spark.createDataFrame(cases, "n int, want int")
    got = df.select("want", PL.chunk_count(F.col("n"), F.lit("required"), F.lit(0), F.lit(0), F.lit("conversation")).alias("k")).collect()
    assert [r["k"] for r in got] == [r["want"] for r in got]
    published = spark.createDataFrame([("w", "f", 1208, 18887, 1358, "required", "conversation")], "work_id string, doc_id string, lines int, estimated_tokens int, seconds int, speaker_stage string, content_mode string")
    plan = PL.chunk_ranges(published).orderBy("extraction_start").collect()
    assert [(p["extraction_start"], p["extraction_end"]) for p in plan] == [(1, 302), (303, 604), (605, 906), (907, 1208)]
    assert (plan[1]["context_start"], plan[1]["context_end"], plan[1]["overlap"]) == (279, 302, 24)


def test_content_modes(spark):
    talk = ["**Speaker 1**: Привет", "*00:01*", "", "**Speaker 2**: Добрый день", "*00:05*", "", "**Speaker 1**: Как дела", "**Speaker 2**: Хорошо"]
    workshop = ["Ведущий: расскажите про себя", "Анна: меня зовут Анна", "Илья: меня зовут Илья", "Марина: я тоже", "Ведущий: спасибо"] * 2
    lecture = [f"Представьте себе мир номер {i}" for i in range(5)]
    hinted = ["*00:01* **Speaker 1**: hello", "*00:02* **Speaker 1**: bye"]
    all_lines = None
    for name, texts in (("talk", talk), ("workshop", workshop), ("lecture", lecture), ("hinted", hinted)):
        own = lines(spark, texts, name)
        all_lines = own if all_lines is None else all_lines.unionByName(own)
    meta = LN.file_meta(all_lines).withColumn("work_id", F.col("doc_id"))
    hints = spark.createDataFrame([("hinted", "youtube", "Alex Name", None)], "work_id string, source_kind string, author_hint string, duration_seconds double")
    got = {r["work_id"]: (r["content_mode"], r["speaker_stage"]) for r in PL.classified(meta, hints).collect()}
    assert got["talk"][0] == "conversation" and got["talk"][1] != "skip"
    assert got["workshop"][0] == "workshop"
    assert got["hinted"] == ("monologue", "skip")


def test_duration_of_last_file_with_one(spark):
    meta = spark.createDataFrame([("w", "a", "10:00"), ("w", "b", "05:00"), ("w", "c", None)], "work_id string, doc_id string, duration_estimate string")
    for c in ("lines", "estimated_tokens", "markers", "dialogue_cues", "dialogue_speakers", "intro_cues"):
        meta = meta.withColumn(c, F.lit(1))
    r = LN.work_totals(meta).first()
    assert (r["duration_seconds"], r["sum_seconds"]) == (300, 900)


def test_utterances_and_merge(spark):
    raw = ["**A**: one", "", "*00:01*", "**A**:  two.", "*00:02*", "and more", "Note without colon", "**B**: .", "**A**: three", "**A**: three"]
    kept = rows(LN.normalised_transcript(lines(spark, raw)).select("utt_no", "speaker", "text", "ts"), "utt_no")
    assert kept == [(1, "A", "one two. and more Note without colon", "00:01"), (2, "A", "three", "")]
    compat = rows(LN.normalised_transcript(lines(spark, raw), compat=True).select("speaker", "text"), "text")
    assert ("A", "one two.") in compat and ("A", "three") in compat


def fold(turns):
    out = []
    for speaker, text, ts in turns:
        if out and out[-1][0] == speaker and out[-1][1] and out[-1][1][-1] not in ".!?…":
            out[-1][1] += " " + text
        else:
            out.append([speaker, text, ts])
    return [tuple(x) for x in out if x[1].strip(" .,;:")]


def test_merge_turns_against_fold(spark):
    rng = random.Random(3)
    docs = {str(d): [(rng.choice("AB"), rng.choice(["", "x", "y.", "z…", "."]), str(i)) for i in range(rng.randint(1, 8))] for d in range(60)}
    df = spark.createDataFrame([(d, i, *t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc_id string, utt_no int, speaker string, text string, ts string")
    got = {}
    for r in LN.merge_turns(df).orderBy("doc_id", "utt_no").collect():
        got.setdefault(r["doc_id"], []).append((r["speaker"], r["text"], r["ts"]))
    assert got == {d: f for d, ts in docs.items() if (f := fold(ts))}
    filled = {d: [t for t in ts if t[1]] for d, ts in docs.items()}
    df = spark.createDataFrame([(d, i, *t) for d, ts in filled.items() for i, t in enumerate(ts)], "doc_id string, utt_no int, speaker string, text string, ts string")
    got = {}
    for r in LN.merge_filled_turns(df).orderBy("doc_id", "utt_no").collect():
        got.setdefault(r["doc_id"], []).append((r["speaker"], r["text"], r["ts"]))
    assert got == {d: f for d, ts in filled.items() if (f := fold(ts))}


def test_densest_window_and_clues(spark):
    texts = [f"line {i}" for i in range(400)]
    for i in (201, 203, 205, 230):
        texts[i] = "Меня зовут Анна **Speaker 3**"
    own = lines(spark, texts)
    scores = {}
    step = max(1, (300 - 40 - 50) // 20)
    for o in range(40, 300 - 50, step):
        window = texts[o : o + 50]
        scores[o] = sum("зовут" in t for t in window) + 2 * len({"3" for t in window if "Speaker 3" in t})
    best = max(scores, key=lambda o: (scores[o], -o))
    assert tuple(LN.densest_window(own, 40).first())[1:] == (best, scores[best])
    context = rows(LN.clue_context(own).filter("clue_no = 1").select("line_no", "mark"), "line_no")
    assert context == [(200, "   "), (201, "   "), (202, ">>>"), (203, "   "), (204, "   ")]
    assert LN.clue_texts(own).first()["clues"][0].split("\n")[2] == ">>> 202: Меня зовут Анна **Speaker 3**"
    assert {r["section"] for r in LN.prescan(own, 40).collect()} == {1, 2, 3, 4}


def test_titles(spark):
    own = lines(spark, ["", "*00:00* **Speaker 1**: ok", "# Про внимание и ритм"])
    assert LN.topic_hint(own).first()["topic_hint"] == "Про внимание и ритм"
    files = spark.createDataFrame([("d", "transcript", "deep-learning-intro")], "doc_id string, stem string, parent string")
    noisy = lines(spark, ["*00:00* **Speaker 1**: и так далее друзья"])
    assert LN.local_title(files, noisy).first()["title"] == "Deep learning intro"
    r = spark.range(1).select(LN.title_candidates(F.lit("Alex Name"), F.array(F.lit("Chapter one"), F.lit("alex name")), F.array(F.lit("lecture"), F.lit("Final words"))).alias("t")).first()["t"]
    assert r == ["Alex Name", "Chapter one", "Final words"]


def round_robin(files, target):
    chosen, seen, r = [], set(), 0
    while len(chosen) < target:
        added = False
        for points in files:
            if r < len(points) and len(chosen) < target:
                p = points[r].strip()
                if p and p.lower() not in seen:
                    chosen.append(p)
                    seen.add(p.lower())
                    added = True
        if not added:
            break
        r += 1
    return chosen


def test_tldr_against_loop(spark):
    rng = random.Random(5)
    works = {str(w): ([[rng.choice("abcdefABC ") for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(1, 4))], rng.randint(1, 8)) for w in range(80)}
    points = spark.createDataFrame([(w, f, p, x) for w, (files, _) in works.items() for f, ps in enumerate(files) for p, x in enumerate(ps)], "work_id string, file_no int, pos int, point string")
    targets = spark.createDataFrame([(w, t) for w, (_, t) in works.items()], "work_id string, target int")
    got = {}
    for r in TL.merged_points(points, targets).orderBy("work_id", "rank").collect():
        got.setdefault(r["work_id"], []).append(r["point"])
    assert got == {w: c for w, (files, t) in works.items() if (c := round_robin(files, t))}
    assert TL.tldr_text(spark.createDataFrame([("w", 1, "a"), ("w", 2, "b")], "work_id string, rank int, point string")).first()["tldr"] == "1. a\n2. b\n"


def test_tldr_targets_and_points(spark):
    df = spark.createDataFrame([(1, 0, 0, 5), (4, 0, 0, 9), (9, 0, 0, 10), (3, 7, 9, 7), (8, 7, 9, 9), (8, 7, 30, 16)], "f int, lo int, hi int, want int")
    assert all(r["t"] == r["want"] for r in df.select("want", TL.target_count(F.col("f"), F.col("lo"), F.col("hi")).alias("t")).collect())
    own = spark.createDataFrame([("w", "A", 1, "1. first"), ("w", "A", 2, "note"), ("w", "A", 3, "- second"), ("w", "B", 1, "plain"), ("w", "B", 2, "")], "work_id string, chunk_id string, line_no int, text string")
    assert rows(TL.summary_points(own).select("chunk_id", "pos", "point"), "chunk_id", "pos") == [("A", 0, "first"), ("A", 1, "second"), ("B", 0, "plain")]


def test_rename_speakers(spark):
    texts = spark.createDataFrame([("w", "**Speaker 1** и Speaker 10, Speaker 11"), ("v", "Speaker 1")], "work_id string, text string")
    maps = spark.createDataFrame([("w", "Speaker 1", "Первый"), ("w", "Speaker 10", "Десятый"), ("w", "Speaker 11", "$1")], "work_id string, pattern string, replacement string")
    got = {r["work_id"]: (r["text"], r["modified"]) for r in SP.rename_speakers(texts, maps).collect()}
    assert got == {"w": ("**Первый** и Десятый, $1", True), "v": ("Speaker 1", False)}


def block_lines(spark, texts, work="w", block=1):
    return spark.createDataFrame([(work, block, i, t) for i, t in enumerate(texts, 1)], "work_id string, block_key int, line_no int, text string")


BLOCK = ["# Блок 1: Страх и ритм", "### Тезисы", "1. Скажи себе: «сегодня хватит»", "2. Просто факт", "### Кейс: x", "3. не тезис", "- *(01:00)* Анна Петрова советует", "**Вывод:** не сопротивляйся"]


def test_appendix(spark):
    manifest = RD.manifest_columns(
        spark.createDataFrame(
            [("w", "A", 1, {"block_file": "b1", "topic": "Страх", "names": "Speaker 1; Алекс Хармози", "resources": "—; Notion", "action_now": "Запиши страх", "action_check": "Проверь гипотезу", "action_avoid": "Избегай спешки"}), ("w", "A", 2, {"block_file": "b2", "title": "Ритм", "primary_claim": "Ритм важен."})],
            "work_id string, chunk_id string, row_no int, m map<string,string>",
        )
    )
    own = block_lines(spark, BLOCK)
    candidates = AP.block_candidates(own)
    assert rows(candidates.select("line_no", "statement"), "line_no") == [(3, "Скажи себе: «сегодня хватит»"), (4, "Просто факт"), (7, "Анна Петрова советует"), (8, "не сопротивляйся")]
    assert {r["topic"] for r in candidates.collect()} == {"Страх и ритм"}
    summary = spark.createDataFrame([("w", 0, "Страх мешает началу пути")], "work_id string, pos int, line string")
    counts = AP.topic_counts(manifest, AP.block_topics(own))
    top = AP.described_topics(AP.top_topics(counts), AP.topic_descriptions(manifest, candidates), summary)
    got = {r["topic"]: r["description"] for r in top.collect()}
    assert got == {"Страх": "Страх мешает началу пути", "Ритм": "Ритм важен", "Страх и ритм": "Скажи себе: «сегодня хватит»"}
    seeds = spark.createDataFrame([("w", "Автор Имя", ["Автор Имя", "unknown", "Гость Один"])], "work_id string, author_hint string, speaker_candidates array<string>")
    people = AP.entity_lines(AP.people_contexts(manifest, candidates, seeds))
    assert {r["name"] for r in people.collect()} == {"Алекс Хармози", "Анна Петрова", "Автор Имя", "Гость Один"}
    resources = AP.entity_lines(AP.entity_contexts(manifest, "resources"))
    actions = AP.top_actions(AP.collected_actions(manifest, candidates, summary))
    found = {(r["bucket"], r["action"]) for r in actions.collect()}
    assert ("immediate", "Запиши страх") in found and ("month", "Проверь гипотезу") in found and ("ongoing", "Избегай спешки") in found
    assert ("ongoing", "не сопротивляйся") in found
    text = AP.appendix_text(spark.createDataFrame([("w",), ("empty",)], "work_id string"), people, resources, actions, top)
    both = {r["work_id"]: r["appendix"] for r in text.collect()}
    assert "## Ресурсы\n- **Notion:** Страх." in both["w"] and "### На постоянной основе\n- [ ] Избегай спешки" in both["w"]
    assert "План действий" not in both["empty"] and "Имена и ресурсы не были явно извлечены" in both["empty"]


def test_no_invented_actions(spark):
    own = block_lines(spark, ["## Блок | 00:00 | Введение", "### Тезисы", "1. Это описание темы", "2. Ещё одно описание"])
    manifest = RD.manifest_columns(spark.createDataFrame([("w", "A", 1, {"topic": "Введение"})], "work_id string, chunk_id string, row_no int, m map<string,string>"))
    none = spark.createDataFrame([], "work_id string, pos int, line string")
    assert AP.collected_actions(manifest, AP.block_candidates(own), none).count() == 0


NOTE = ["# Title", "> abstract", "**Автор:** A", "**Формат:** F", "**Тема:** T", "**Длительность:** 1", "**Источник:** S", "## Главная рамка автора", "### Смысл блока:", "text", "### Кейс: Один", "c", "### Кейс: один", "", "- [ ] Сделай шаг", "- [ ] страница"]


def test_quality_and_gate(spark):
    contract = CT.note_contract(spark.createDataFrame([("w", "conversation", "multi", 7500, 5, "Alex Name")], "work_id string, content_mode string, execution_mode string, duration_seconds int, total_chunks int, author_hint string")).select("work_id", "contract")
    works = spark.createDataFrame([("w", 2, 1, 7500), ("bare", 1, 0, 0)], "work_id string, block_count int, tldr_count int, duration_seconds int").join(contract, "work_id", "left")
    own = lines(spark, NOTE, "w", "work_id").unionByName(lines(spark, ["text Speaker 4", "- **—** unknown"], "bare", "work_id"))
    got = {r["work_id"]: r for r in QL.contract_errors(QL.final_quality(own, works)).collect()}
    w, bare = got["w"], got["bare"]
    assert w["header_complete"] and w["duplicate_case_titles"] == ["один"] and (w["meaning_blocks"], w["case_blocks"]) == (1, 2)
    assert w["actionability"]["ratio"] == 0.5 and not w["density"]["ok"] and not w["longform"]["ok"] and not w["tldr_length_ok"]
    assert len(w["contract_errors"]) == 5
    assert bare["placeholder_hits"] == ["Speaker N", "—", "unknown"] and bare["contract_errors"] == [] and bare["density"]["ok"]
    assert bare["missing_header_fields"][-1] == "Главная рамка автора"
    outcome = spark.createDataFrame([(["e"], 0), ([], 0), ([], 7)], "e array<string>, c int").select(QL.assemble_outcome(F.col("e"), F.col("c")).alias("x"), QL.run_status(F.col("e"), F.col("c")).alias("s"))
    assert [tuple(r) for r in outcome.collect()] == [(2, "contract-failed"), (0, "assembled"), (7, "failed")]
    reasons = spark.createDataFrame([(["e"], True, "c", False), (["e"], False, "c", False), ([], True, "c", False), ([], False, "c", True), ([], False, "", False), ([], False, "c", False)], "e array<string>, s boolean, c string, d boolean")
    assert [r["r"] for r in reasons.select(QL.delivery_reason(F.col("e"), F.col("s"), F.col("c"), F.col("d")).alias("r")).collect()] == ["skipped-by-request", "contract-errors", "skipped-by-request", "already-delivered-current-html", "disabled", None]
    assert QL.quality_summary(QL.contract_errors(QL.final_quality(own, works))).count() == 2
    assert QL.quote_and_case_totals(own).filter("work_id = 'w'").first()["cases"] == 2


def test_contract_and_prepare_quality(spark):
    works = spark.createDataFrame([("w", "monologue", "single", 600, 1, "Иван Петров", "skip", "youtube"), ("v", "workshop", "multi", 9600, 5, None, "required", None)], "work_id string, content_mode string, execution_mode string, duration_seconds int, total_chunks int, author_hint string, speaker_stage string, source_kind string")
    c = {r["work_id"]: r["contract"] for r in CT.note_contract(works).collect()}
    assert c["w"]["header"]["required_metadata"][0] == "Автор" and c["w"]["header"]["format_label"] == "лекция" and c["w"]["tldr"]["min_items"] == 5 and c["w"]["tldr"]["strategy"] == "inline-extraction"
    assert c["v"]["blocks"]["min_case_blocks_floor"] == 5 and c["v"]["blocks"]["theses_max"] == 11 and c["v"]["header"]["optional_metadata"] == ["Участники"]
    q = {r["work_id"]: r for r in CT.prepare_quality(works).collect()}
    assert q["w"]["fast_path_expected"] and q["w"]["fast_path_ok"] and q["w"]["fragmentation_ok"] and not q["v"]["fragmentation_ok"]


def test_chunk_statuses_and_plan(spark):
    plan = spark.createDataFrame([("w", c, f"f{c}", [f"manifest_chunk_{c}.tsv"]) for c in "ABCDE"], "work_id string, chunk_id string, chunk_fingerprint string, expected_outputs array<string>")
    names = ["chunk_A_block_01.md", "manifest_chunk_A.tsv", "chunk_B_block_01.md", "manifest_chunk_C.tsv", "chunk_C_block_01.md", "manifest_chunk_X.tsv", "manifest_chunk_E.tsv", "tldr.md"]
    files = spark.createDataFrame([("w", n) for n in names], "work_id string, name string")
    sentinels = spark.createDataFrame([("w", "C", "other", []), ("w", "E", "fE", ["manifest_chunk_E.tsv", "gone.md"])], "work_id string, chunk_id string, fingerprint string, outputs array<string>")
    statuses = ST.chunk_statuses(plan, ST.observed_chunks(files), sentinels, files)
    assert {r["chunk_id"]: r["status"] for r in statuses.collect()} == {"A": "ready", "B": "partial", "C": "stale", "D": "missing", "E": "partial", "X": "stale"}
    roll = ST.extraction_rollup(statuses)
    assert tuple(roll.first()) == ("w", "stale", 5, 1, 2, 1, 1)
    works = roll.select("work_id", "extraction").withColumns({"speaker_hint": F.lit("required"), "has_speakers": F.lit(False), "has_tldr": F.lit(True), "has_html": F.lit(False), "fingerprint": F.lit("x"), "tldr_fingerprint": F.lit("x"), "assemble_fingerprint": F.lit(None).cast("string"), "stored_speaker": F.lit(None).cast("string"), "stored_tldr": F.lit("ready"), "stored_assemble": F.lit("failed"), "total_chunks": F.lit(5), "content_mode": F.lit("conversation"), "execution_mode": F.lit(""), "reused": F.lit(False)})
    r = ST.execution_plan(ST.stage_statuses(works), statuses).first()
    assert (r["speaker"], r["tldr"], r["assemble"]) == ("missing", "stale", "failed")
    assert r["next_action"] == "speaker-identification" and r["mode"] == "multi" and r["resume"]
    assert r["blocked_by"] == ["speaker_identification", "extraction", "tldr"] and r["pending_chunk_ids"] == ["B", "C", "D", "E"] and not r["run_assemble"]
    assert ST.status_payload(ST.stage_statuses(works), statuses, files).first()["manifests"] == 4
    done = spark.createDataFrame([("w", "A", "fA"), ("w", "B", "old")], "work_id string, chunk_id string, chunk_fingerprint string")
    assert [r["chunk_id"] for r in ST.pending(plan, done).orderBy("chunk_id").collect()] == ["B", "C", "D", "E"]
    assert ST.normalised_plan(spark.createDataFrame([(" A ", None), (None, "B"), ("", None)], "chunk_id string, id string")).count() == 2
    assert ST.reusable(plan.withColumnRenamed("chunk_fingerprint", "fingerprint"), spark.createDataFrame([("fA",)], "fingerprint string")).count() == 1


def test_changes_and_deliveries(spark):
    runs = spark.createDataFrame([("r1", "n", 1, "t", "m", "h", "q", ""), ("r2", "n", 2, "t", "m2", "h2", "q2", "d"), ("r3", "n", 3, "t", "m2", "h2", "q2", "d"), ("x", "o", 1, "t", None, None, None, None)], "run_id string, note_id string, finished_at int, transcript string, markdown string, html string, quality string, delivery string")
    f = {r["run_id"]: (r["first_run"], r["input_changed"], r["output_changed"], r["quality_changed"], r["delivery_changed"], r["only_resume"]) for r in ST.change_flags(runs).collect()}
    assert f["r2"] == (False, False, True, True, True, False) and f["r3"] == (False,) * 5 + (True,)
    assert f["x"] == (True, True, False, False, False, False)
    notes = spark.createDataFrame([("t", "/a", "c", "h1"), ("t", "/b", "c", "h2"), ("t", "/c", "c", "h3")], "title string, path string, chat string, sha256 string")
    sent = spark.createDataFrame([("t", "/a", "c", "h1", True), ("t", "/b", "c", "old", True), ("t", "/c", "", None, True)], "title string, path string, chat string, sha256 string, success boolean")
    assert [r["path"] for r in ST.already_delivered(notes, sent).orderBy("path").collect()] == ["/a", "/c"]
    latest = ST.latest_state(runs.select("note_id", "run_id", "finished_at"), "note_id", ("finished_at", "run_id"))
    assert {r["note_id"]: r["run_id"] for r in latest.collect()} == {"n": "r3", "o": "x"}
    sources = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "work_id string, modified int")
    derived = spark.createDataFrame([("a", 9), ("b", 2)], "work_id string, modified int")
    assert sorted(r["work_id"] for r in ST.newer_sources(derived, sources).collect()) == ["b", "c"]


def test_block_checks(spark):
    blocks = spark.createDataFrame([("w", "A", 1, "t", "1. a\n2. b"), ("w", "B", 1, "t", "\n".join(f"{i}. x" for i in range(7))), ("w", "B", 2, "t", "")], "work_id string, chunk_id string, block_no int, topic string, body string")
    assert rows(QL.shallow_blocks(blocks).select("chunk_id", "block_no", "theses"), "chunk_id", "block_no") == [("A", 1, 2), ("B", 2, 0)]
    assert rows(QL.boundary_duplicates(blocks).select("chunk_id", "block_no"), "block_no") == [("B", 1)]
    gaps = spark.createDataFrame([("w", 1, 0, 100), ("w", 2, 300, None), ("w", 3, 500, 600), ("w", 4, 650, 700)], "work_id string, row_no int, start_s int, end_s int")
    assert rows(QL.coverage_gaps(gaps).select("row_no", "gap_s"), "row_no") == [(3, 400)]


def test_reports_and_prompts(spark):
    own = lines(spark, recording(643, 1920, False))
    meta = LN.file_meta(own).withColumn("work_id", F.lit("w"))
    plan = PL.planned(meta, own)
    works = PL.classified(meta).select("work_id", F.col("speaker_stage").alias("stage"), F.col("speaker_reason").alias("reason"), F.col("content_mode").alias("mode"), F.lit(40).alias("prescan_limit"), F.lit("32:00").alias("duration"))
    report = WR.prepare_report(plan, meta, works)
    parsed = RD.prepare_reports(report.select(F.col("work_id").alias("doc_id"), F.col("report").alias("text"))).first()
    assert (parsed["files"], parsed["total_lines"], parsed["total_chunks"], parsed["duration_estimate"]) == (1, 643, 3, "32:00")
    assert WR.chunk_prompts(plan).filter("chunk_id = 'A'").first()["prompt"].split("\n")[1] == "Context lines: none"
    seed = PL.header_seed(spark.createDataFrame([("w", ["T"], "skip", "A")], "work_id string, title_candidates array<string>, speaker_stage string, author_hint string")).first()
    assert (seed["topic_hint"], seed["participants_hint"]) == ("T", "single-speaker (likely A)")
    r = spark.createDataFrame([("a.MP3",), ("a.md",), ("a.pdf",)], "p string").select(PL.batch_route(F.col("p")).alias("r"))
    assert [x["r"] for x in r.collect()] == ["audio", "local", None]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id string, line_no int, text string")
    assert LN.file_meta(none).count() == LN.normalised_transcript(none).count() == LN.densest_window(none, 40).count() == RD.parse_vtt(none).count() == 0
    meta = LN.file_meta(none).withColumn("work_id", F.lit("w"))
    assert PL.planned(meta, none).count() == 0


def test_state_fallbacks_and_timeline(spark):
    works = spark.createDataFrame([("a",), ("b",), ("c",)], "work_id string")
    states = spark.createDataFrame([("a", "multi", None)], "work_id string, mode string, files int")
    plans = spark.createDataFrame([("a", "single", 2), ("b", "single", None)], "work_id string, mode string, files int")
    reports = spark.createDataFrame([("b", 7), ("c", 9)], "work_id string, files int")
    assert rows(ST.loaded_state(works, states, plans, reports), "work_id") == [("a", "multi", 2), ("b", "single", 7), ("c", None, 9)]
    d = ST.delivery_summary(spark.createDataFrame([("a", True, None, "disabled")], "work_id string, enabled boolean, chat string, reason string"))
    assert d.first()["delivery"] == {"enabled": "true", "reason": "disabled"}
    runs = spark.createDataFrame([("r", "n", 1, "t", None, None, "", "", "local", "source-ready", "T")], "run_id string, note_id string, finished_at int, transcript string, markdown string, html string, quality string, delivery string, command string, status string, title string")
    r = ST.timeline(runs).first()
    assert r["change_flags"]["first_run"] and r["change_flags"]["input_changed"] and not r["change_flags"]["output_changed"]


def test_long_timestamps(spark):
    own = lines(spark, ["*99:59* a", "*120:01* b"])
    assert LN.file_meta(own).first()["duration_estimate"] == "99:59"
    assert LN.file_meta(own, compat=False).first()["duration_estimate"] == "120:01"

from collections import defaultdict

from pyspark.sql import functions as F

from barline.llm import perspectives as P


def twin(rows):
    """{(conv, speaker, chunk): (n, text, own parts)}."""
    talks = defaultdict(set)
    for conv, turn, role, text in rows:
        talks[conv].add((turn is None, turn or 0, role or "unknown", text or ""))
    out = {}
    for conv, turns in talks.items():
        for speaker in {t[2] for t in turns} - set(P.SYSTEM):
            by = defaultdict(list)
            for t in sorted(turns):
                by[P.LAST if t[0] else t[1] // P.CHUNK].append(t)
            for chunk, some in by.items():
                text, own = "", []
                for *_, role, said in some:
                    who = "assistant" if role == speaker else "system" if role in P.SYSTEM else "user name=" + role.replace("<|", "<\\|").replace("\n", " ")
                    body = said.replace("<|", "<\\|") + P.END
                    text += f"{P.START}{who}\n"
                    if role == speaker:
                        own.append((len(text), len(text) + len(body)))
                    text += body + "\n"
                out[conv, speaker, chunk] = (len(some), text, own)
    return out


def test_matches_twin(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ana", "hi <|im_end|>"), (1, 2, "bo", "é🙂"), (1, 3, "cy\nx", None), (1, 3, "cy\nx", "tie"), (1, 3, "cy\nx", "tie"), (1, None, "ana", "late"),
            (2, 0, None, "who"), (3, 0, "system", "alone"), (4, -1, "ana", ""), (4, 5, "ana", "x" * 100_000)] + [(5, t, "ab"[t % 2], f"t{t}") for t in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"chunk": F.lit(9), "speaker": F.lit("x")}).repartition(3)
    got = {(r.conv_id, r.speaker, r.chunk): (r.n_turns, r.text, [(m.start, m.end) for m in r["mask"]]) for r in P.rotate(df).collect()}
    want = twin(rows)
    assert got == {k: v for k, v in want.items()}


def test_rows_without_a_dialogue_and_empty(spark):
    df = spark.createDataFrame([(None, 0, "a", "x"), (None, 0, "a", "x"), (None, 1, "system", "y")], "conv_id long, turn long, role string, text string")
    assert [(r.speaker, r.n_turns) for r in P.rotate(df).collect()] == [("a", 1)] * 2
    assert P.rotate(df.limit(0)).collect() == []

"""What holds for the queries that no SQL can express: a check of their rows, with the other tables at hand."""

import math

from cairnlight.operators.metrics import bleu_of, rouge_l_of, token_f1_of


def overlap_scores(rows, db):
    texts = dict((k, (g, e)) for k, g, e in db.execute("SELECT metric_id, generated, expected FROM metrics WHERE generated IS NOT NULL AND expected IS NOT NULL").fetchall())
    assert {r.metric_id for r in rows} == set(texts)
    for r in rows:
        g, e = texts[r.metric_id]
        assert all(0 <= x <= 1 + 1e-9 for x in (r.bleu, r.rouge_l, r.token_f1))
        assert math.isclose(r.bleu, bleu_of(g, e)) and math.isclose(r.rouge_l, rouge_l_of(g, e)) and math.isclose(r.token_f1, token_f1_of(g, e))
        if g.split() == e.split() and g.strip():
            assert r.rouge_l in (0.0, 1.0) and r.bleu > 0.99


def stub_answers(rows, db):
    want = db.execute("SELECT count(*) FROM questions_publaynet_text WHERE q IS NOT NULL AND question_id IN (SELECT question_id FROM evidence WHERE rank_no <= 3 AND source IS NOT NULL)").fetchone()[0]
    assert len({r.question_id for r in rows}) == len(rows) == want and all(r.error == "" and "\n" not in r.text for r in rows)


def stub_retrieval(rows, db):
    asked = db.execute("SELECT count(*) FROM questions_publaynet_text WHERE q IS NOT NULL AND question_id % 50 = 0").fetchone()[0]
    by = {}
    for r in rows:
        by.setdefault(r.qid, []).append(r.rank)
    assert len(by) == asked and all(sorted(v) == [1, 2, 3] for v in by.values())


def unicode_names(rows, db):
    n = db.execute("SELECT count(*) FROM questions_publaynet_text").fetchone()[0]
    assert len(rows) == n and all(r.file_name is None or r.file_name.isascii() and 0 < len(r.file_name) <= 107 and not set(r.file_name) & set("<>:\"/\\|?*,()'[] ") for r in rows)


def ablation(rows, db):
    n = len(rows[0].asDict()) and {r.questions for r in rows}
    assert len(rows) == 8 and len(n) == 1 and [r.system for r in rows][::2] == ["baseline", "+KG", "+multimodal", "+both"] and all(0 <= r.recall <= 1 and r.errors == 0 for r in rows)


def authored(rows, db):
    taken = [r for r in rows if r.rejected is None]
    assert len({r.doc_id for r in rows}) == len(rows) <= 240 and len(taken) <= 40 and all((r.q is None) == (r.rejected == "unreadable") for r in rows)


PROPERTIES = {"n1_overlap_scores": overlap_scores, "n2_stub_answers": stub_answers, "n3_stub_retrieval": stub_retrieval, "n4_unicode_filenames": unicode_names, "n5_ablation": ablation, "n6_authored_questions": authored}

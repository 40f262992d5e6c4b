"""Questions that point outside themselves, against one pattern of all pointers and things."""

from __future__ import annotations

import random
import re

from brindle.operators import golden


def test_questions_that_point_outside(spark):
    rng = random.Random(4)
    parts = [*golden.DEICTIC, *golden.POINTED_AT, " ", " ", " ", ",", "(", ".", "의", "x", "\n", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(3_000)] + ["위의 문서는?", "이 (해당 문서", "이 해당문서", "", "본문서", "위의견 문서"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, text string")
    got = {r.id: r.found for r in rows.select("id", golden.points_outside(rows.text).alias("found")).collect()}
    pattern = re.compile(rf"(^|[\s,.(])({'|'.join(golden.DEICTIC)})\s*({'|'.join(golden.POINTED_AT)})")
    assert [got[i] for i in range(len(texts))] == [pattern.search(t) is not None for t in texts] and got[len(texts)] is False
    assert 300 < sum(got.values()) < 2_700
    own = rows.select(golden.points_outside(rows.text, ("x",), ("의",)).alias("found")).where("found").count()
    assert own == sum(re.search(r"(^|[\s,.(])x\s*의", t) is not None for t in texts)

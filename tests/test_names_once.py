"""Rules over a file name compute its tokens once, not anew at each place that uses them."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from segno.functions import names as N


def test_guess_part_computes_the_tokens_once(spark):
    rows = spark.createDataFrame([("a/ElecGtr2DI.wav",), ("BassDrum7.wav",), ("Rhodes_mix.wav",), ("mix1.wav",), (None,)], "s string").select("s", N.guess_part(F.col("s")).alias("g"))
    with redirect_stdout(io.StringIO()) as said:
        rows.explain(True)
    plan = said.getvalue().split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert plan.count("regexp_extract_all") == 1
    got = [tuple(x.g) for x in rows.collect()]
    assert got[:4] == [("di", "guitar", True, True, 2), ("drums", "drums", False, False, None), ("keys", "keys", False, False, None), ("mix", "other", False, False, None)]

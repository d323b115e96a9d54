"""Run names, paths and small training arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _contains(path: Column, *needles: str) -> Column:
    hit = F.lit(True)
    for needle in needles:
        hit = hit & F.contains(path, F.lit(needle))
    return hit


def model_short_name(path: Column) -> Column:
    """Friendly name of a model path.

    Hub names and other paths give their last segment. Paths under ``saved_models``
    follow the directory conventions below; the first matching row wins.
    """
    parts = F.split(path, "/")

    def seg(i: int) -> Column:
        return F.get(parts, F.lit(i))

    third_last = F.try_element_at(parts, F.lit(-3))
    # Words in the path -> name.
    conventions = [
        (("declutr", "few_epoch", "span_comparison"), F.concat(seg(9), F.lit("/declutr/"), third_last)),
        (("declutr", "few_epoch"), F.concat(seg(8), F.lit("_declutr_"), third_last)),
        (("declutr",), F.concat(seg(7), F.lit("/declutr/"), third_last)),
        (("contrastive",), seg(7)),
        (("custom_pretraining",), seg(7)),
        (("simcse",), F.lit("simcse-mimic")),
        ((), seg(7)),
    ]
    name = F.when(~_contains(path, "saved_models"), F.element_at(parts, -1))
    for needles, value in conventions:
        name = name.when(_contains(path, *needles), value)
    return name


def run_path(
    root: str, task: Column, few_shot_n: Column, model: Column, method: Column, ts: Column
) -> Column:
    """``root/task/full|fewshot_n/model/method/dd-MM-yyyy--HH-mm/``."""
    size = F.when(few_shot_n.isNull(), F.lit("full")).otherwise(
        F.concat(F.lit("fewshot_"), few_shot_n.cast("string"))
    )
    stamp = F.date_format(ts, "dd-MM-yyyy--HH-mm")
    return F.concat(F.concat_ws("/", F.lit(root), task, size, model, method, stamp), F.lit("/"))


def warmup_steps(n_rows: Column, batch_size: int, epochs: int, share: float = 0.06) -> Column:
    return F.lit(share) * (n_rows.cast("double") / batch_size * min(epochs, 5))


def scaled_int(rank: Column, factor: Column) -> Column:
    """Half-even rounding of ``rank * factor``."""
    return F.bround(rank.cast("double") * factor.cast("double"), 0).cast("int")


def elapsed_seconds(ts: Column, start: Column) -> Column:
    return F.timestamp_diff("SECOND", start, ts)


def seeded_key(seed: int, *ids: Column) -> Column:
    """The sort key of every seeded order: md5 of ``seed:id[:id…]``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ids]))

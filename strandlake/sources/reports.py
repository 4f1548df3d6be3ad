"""Accuracy reports as text, in the layout that readers of such reports expect (diploid). Tables come from concordance; here are only lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import concordance

# Prefixes and headings of the sections, as other programs parse them, spelling included.
SCOPES = (("S", "SNP", "SNPs"), ("I", "INDEL", "indels"), ("V", concordance.ALL, "Variants: SNPs + indels"))
COUNTS = "#val_gt_RR #val_gt_RA #val_gt_AA {filtered} RR_hom_matches RA_het_matches AA_hom_matches RR_hom_mismatches RA_het_mismatches AA_hom_mismatches RR_hom_mismatches_rate_percent RA_het_mismatches_rate_percent"
SAMPLE_HEAD = "id sample_name " + COUNTS.format(filtered="#filtered_gp") + " AA_hom_mimatches non_reference_discordanc_rate_percent best_gt_rsquared imputed_ds_rsquared"
BIN_HEAD = "id n_genotypes mean_AF " + COUNTS.format(filtered="filtered_gp") + " AA_hom_mimatches_rate_percent best_gt_rsquared imputed_ds_rsquared"
CALIBRATION_HEAD = "id start_bin end_bin avg_bin RR_hom_matches RA_het_matches AA_hom_matches RR_hom_mismatches RA_het_mismatches AA_hom_mismatches RR_hom_mismatches_rate_percent RA_het_mismatches_rate_percent AA_hom_mimatches_rate_percent all_mismatches_rate_percent"

KINDS = ("rr", "ra", "aa")


def decimals(value: Column | str, n: int) -> Column:
    return F.format_string(f"%.{n}f", F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0.0)).cast("double"))


def _valid() -> list[Column]:
    return [F.sum((F.col("truth_code") == k).cast("long")).alias(f"val_{name}") for k, name in enumerate(KINDS)]


def _genotypes() -> list[Column]:
    return [*(F.col(f"val_{k}") for k in KINDS), F.col("n_filtered"), *(F.col(f"n_{k}") - F.col(f"err_{k}") for k in KINDS), *(F.col(f"err_{k}") for k in KINDS), *(decimals(f"rate_{k}", 3) for k in KINDS)]


def _words(columns: list[Column]) -> Column:
    return F.concat_ws(" ", *(c.cast("string") for c in columns))


def _sections(rows: DataFrame, title: str, tag: str, head: str, columns: list[Column]) -> DataFrame:
    """(section, place, value): for each scope two headings and a line a row (vtype, place, ...)."""
    spark, parts = rows.sparkSession, []
    for k, (letter, vtype, named) in enumerate(SCOPES):
        heads = [(k, -2, f"#{title} ({named})"), (k, -1, f"#{tag.format(letter)} {head}")]
        body = rows.filter(F.col("vtype") == vtype).select(F.lit(k).alias("section"), F.col("place").cast("long").alias("place"), _words([F.lit(tag.format(letter)), *columns]).alias("value"))
        parts += [spark.createDataFrame(heads, "section int, place long, value string"), body]
    return reduce(DataFrame.unionByName, parts)


def by_sample(eval_: DataFrame) -> DataFrame:
    """SNK-06: concordance by sample, for each scope."""
    rows = concordance.report(eval_, "sample", _valid())
    order = rows.select("sample").distinct().withColumn("place", F.row_number().over(Window.orderBy("sample")) - 1)  # a row a sample
    columns = [F.col("place"), F.col("sample"), *_genotypes(), decimals("nrd", 3), decimals("r2_best", 6), decimals("r2_ds", 6)]
    return _sections(rows.join(order, "sample"), "Genotype concordance by sample", "GCs{}", SAMPLE_HEAD, columns)


def by_bin(eval_: DataFrame) -> DataFrame:
    """SNK-07: concordance by bin of allele frequency, for each scope."""
    mean = F.avg(F.when(F.col("used"), F.col("maf"))).alias("mean_maf")
    rows = concordance.report(eval_.filter("af_bin >= 0"), "af_bin", [*_valid(), mean]).withColumn("place", F.col("af_bin"))
    columns = [F.col("af_bin"), F.col("n_used"), decimals("mean_maf", 6), *_genotypes(), decimals("r2_best", 6), decimals("r2_ds", 6)]
    return _sections(rows, "Genotype concordance by allele frequency bin", "GCs{}AF", BIN_HEAD, columns)


def by_calibration(eval_: DataFrame, bins: int = 100) -> DataFrame:
    """SNK-08: errors by the best guess's probability, for each scope."""
    scopes = [concordance.calibration(eval_ if vtype == concordance.ALL else eval_.filter(F.col("vtype") == vtype), bins).withColumn("vtype", F.lit(vtype)) for _, vtype, _ in SCOPES]
    rows = reduce(DataFrame.unionByName, scopes).withColumn("place", F.col("cal_bin"))
    rates = [decimals(F.when(F.col(f"n{k}") > 0, 100.0 * F.col(f"e{k}") / F.col(f"n{k}")), n) for k, n in enumerate((6, 6, 4))]
    columns = [F.col("cal_bin"), decimals("low", 2), decimals("high", 2), decimals((F.col("low") + F.col("high")) / 2, 3), *(F.col(f"n{k}") - F.col(f"e{k}") for k in range(3)), *(F.col(f"e{k}") for k in range(3)), *rates, decimals("error", 6)]
    return _sections(rows, "Genotype concordance by calibration bin", "GCs{}C", CALIBRATION_HEAD, columns)


def r2_by_bin(eval_: DataFrame) -> DataFrame:
    """SNK-09: bin, genotypes, mean frequency, r2 of best guesses and dosages."""
    mean = F.avg(F.when(F.col("used"), F.col("maf"))).alias("mean_maf")
    rows = concordance.report(eval_.filter("af_bin >= 0"), "af_bin", [mean]).filter(F.col("vtype") == concordance.ALL)
    columns = [F.col("af_bin"), F.col("n_used"), decimals("mean_maf", 6), decimals("r2_best", 6), decimals("r2_ds", 6)]
    return rows.select(F.lit(0).alias("section"), F.col("af_bin").cast("long").alias("place"), _words(columns).alias("value"))


def r2_by_sample(eval_: DataFrame) -> DataFrame:
    """SNK-09: sample, r2 of best guesses and dosages."""
    rows = concordance.report(eval_, "sample").filter(F.col("vtype") == concordance.ALL)
    place = F.row_number().over(Window.orderBy("sample")) - 1  # a row a sample
    return rows.select(F.lit(0).alias("section"), place.cast("long").alias("place"), _words([F.col("sample"), decimals("r2_best", 6), decimals("r2_ds", 6)]).alias("value"))


#: Names of the report files, by what makes their lines.
FILES = {"error.spl.txt": by_sample, "error.grp.txt": by_bin, "error.cal.txt": by_calibration, "rsquare.grp.txt": r2_by_bin, "rsquare.spl.txt": r2_by_sample}


def write_all(eval_: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """SNK-06 to SNK-09: every report in a folder of its own, one ordered file each (reports are small)."""
    for name, lines in FILES.items():
        ordered = lines(eval_).repartition(1).sortWithinPartitions("section", "place").select("value")
        ordered.write.mode("overwrite").option("compression", compression or "none").text(f"{path}.{name}")

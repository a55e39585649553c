"""Queries over peak tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.operators import detection
from strandflow.plans.registry import query
from strandflow.sources import tracks

AT = ["dataset", "t", "z", "y", "x"]
BAND = "CASE WHEN prob>0.90::double AND prob<=0.95::double THEN '(0.9,0.95]' WHEN prob>0.95::double AND prob<=0.98::double THEN '(0.95,0.98]' WHEN prob>0.98::double AND prob<=0.99::double THEN '(0.98,0.99]' WHEN prob>0.99::double AND prob<=0.995::double THEN '(0.99,0.995]' END"
#: What is persisted as a detection in these queries: peaks above .995 but for every 40th place, and some that are no such peaks.
KEPT = "(SELECT DISTINCT dataset,t,z,y,x FROM peaks WHERE (prob>0.995::double AND (x*7+y)%40<>0) OR (x*11+y)%300=0)"


def kept(p):
    return p.where("(prob > double(0.995) AND (x*7+y) % 40 <> 0) OR (x*11+y) % 300 = 0").select(*AT).distinct()


@query(f"SELECT dataset, {BAND} band, count(*) n FROM peaks WHERE prob>0.90::double AND prob<=0.995::double GROUP BY ALL")
def release_bands(spark, d):
    p = tracks.peaks(spark, d).withColumn("band", detection.release_band(F.col("prob"))).where("band IS NOT NULL")
    return p.groupBy("dataset", "band").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT dataset, bin, count(*) n FROM (SELECT dataset, CASE WHEN prob>0.99::double THEN '>0.99' WHEN prob>0.95::double THEN '>0.95' WHEN prob>0.90::double THEN '>0.90' ELSE 'none' END bin FROM peaks) GROUP BY ALL")
def confidence_bins(spark, d):
    """The highest threshold whose key set holds a detection: detections and key sets are one union, grouped by key once."""
    p = tracks.peaks(spark, d)
    sets = F.array_compact(F.array(F.lit(0), *[F.when(F.col("prob") > least, F.lit(k)) for k, least in ((1, 0.90), (2, 0.95), (3, 0.99))]))
    top = p.select(*AT, F.explode(sets).alias("k")).groupBy(*AT).agg(F.max("k").alias("k"))
    label = F.when(F.col("k") == 3, ">0.99").when(F.col("k") == 2, ">0.95").when(F.col("k") == 1, ">0.90").otherwise("none")
    return top.groupBy("dataset", label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p.dataset, p.t, p.z, p.y, p.x FROM peaks p WHERE prob>0.95::double AND NOT EXISTS (SELECT 1 FROM peaks o WHERE o.dataset=p.dataset AND o.t=p.t AND abs(o.z-p.z)<=2 AND abs(o.y-p.y)<=4 AND abs(o.x-p.x)<=4 AND o.prob>p.prob)")
def local_maxima(spark, d):
    return detection.local_maxima(tracks.peaks(spark, d), 0.95, (2, 4, 4)).select(*AT)


@query("SELECT dataset, t, z, y, x, round(greatest((prob-lo)/(hi-lo+1e-6::double),0),6) v FROM peaks JOIN (SELECT dataset, quantile_cont(prob,0.001) lo, quantile_cont(prob,0.999) hi FROM peaks GROUP BY 1) USING (dataset)")
def quantile_normalize(spark, d):
    p = tracks.peaks(spark, d)
    q = p.groupBy("dataset").agg(F.percentile("prob", 0.001).alias("lo"), F.percentile("prob", 0.999).alias("hi"))
    return p.join(q, "dataset").select(*AT, F.round(F.greatest((F.col("prob") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6), F.lit(0.0)), 6).alias("v"))


@query(f"SELECT p.dataset, p.t, p.z, p.y, p.x, round(prob,6) prob FROM peaks p ANTI JOIN {KEPT} k USING (dataset,t,z,y,x) WHERE prob>0.90::double")
def suppressed_peaks(spark, d):
    p = tracks.peaks(spark, d)
    return p.where("prob > double(0.90)").join(kept(p), AT, "left_anti").select(*AT, F.round("prob", 6).alias("prob"))


@query(f"SELECT dataset, count(*) FILTER (WHERE side='peaks') only_peaks, count(*) FILTER (WHERE side='kept') only_kept FROM (SELECT 'peaks' side, dataset FROM (SELECT dataset,t,z,y,x FROM peaks WHERE prob>0.995::double EXCEPT SELECT * FROM {KEPT} k) UNION ALL SELECT 'kept', dataset FROM (SELECT * FROM {KEPT} k EXCEPT SELECT dataset,t,z,y,x FROM peaks WHERE prob>0.995::double)) GROUP BY 1")
def detection_parity(spark, d):
    """Both differences of high peaks and persisted detections per dataset, from one full join."""
    p = tracks.peaks(spark, d)
    a, b = p.where("prob > double(0.995)").select(*AT, F.lit(1).alias("a")), kept(p).withColumn("b", F.lit(1))
    j = a.join(b, AT, "full_outer").where("a IS NULL OR b IS NULL")
    return j.groupBy("dataset").agg(F.count("a").alias("only_peaks"), F.count("b").alias("only_kept"))


@query("SELECT dataset, count(*) FILTER (WHERE prob>0.99::double) n99, count(*) FILTER (WHERE prob>0.98::double) n98, count(*) FILTER (WHERE prob>0.95::double) n95, count(*) FILTER (WHERE prob>0.90::double) n90 FROM peaks GROUP BY 1")
def nested_threshold_counts(spark, d):
    return tracks.peaks(spark, d).groupBy("dataset").agg(*[F.count(F.when(F.col("prob") > v, 1)).alias(k) for k, v in (("n99", 0.99), ("n98", 0.98), ("n95", 0.95), ("n90", 0.90))])


@query("SELECT count(*) outside FROM (SELECT dataset,t,z,y,x FROM peaks WHERE prob>0.99::double EXCEPT SELECT dataset,t,z,y,x FROM peaks WHERE prob>0.95::double)")
def threshold_nesting(spark, d):
    p = tracks.peaks(spark, d)
    return p.where("prob > double(0.99)").join(p.where("prob > double(0.95)"), AT, "left_anti").agg(F.count(F.lit(1)).alias("outside"))


@query("SELECT p.dataset, p.t, p.z, p.y, p.x, count(*) n, round(p.prob-quantile_cont(o.prob,0.5),6) contrast, round(CASE WHEN stddev_pop(o.prob)>1e-9 THEN (p.prob-avg(o.prob))/stddev_pop(o.prob) ELSE 0 END,4) score FROM peaks p JOIN peaks o ON o.dataset=p.dataset AND o.t=p.t AND abs(o.z-p.z)<=3 AND abs(o.y-p.y)<=6 AND abs(o.x-p.x)<=6 GROUP BY p.dataset,p.t,p.z,p.y,p.x,p.prob")
def peak_contrast(spark, d):
    j = detection.box_pairs(tracks.peaks(spark, d), (3, 6, 6)).groupBy(*AT, "prob").agg(F.count(F.lit(1)).alias("n"), F.percentile("oprob", 0.5).alias("m"), F.avg("oprob").alias("a"), F.stddev_pop("oprob").alias("s"))
    score = F.when(F.col("s") > 1e-9, (F.col("prob") - F.col("a")) / F.col("s")).otherwise(0.0)
    return j.select(*AT, "n", F.round(F.col("prob") - F.col("m"), 6).alias("contrast"), F.round(score, 4).alias("score"))


@query("SELECT dataset, count(*) n, round(avg(prob),6) mean, round(stddev_pop(prob),6) std, round(quantile_cont(prob,0.5),6) p50, round(quantile_cont(prob,0.9),6) p90, round(quantile_cont(prob,0.99),6) p99, round(max(prob),6) max FROM peaks GROUP BY 1")
def intensity_stats(spark, d):
    q = [F.round(F.percentile("prob", x), 6).alias(k) for k, x in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    return tracks.peaks(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prob"), 6).alias("mean"), F.round(F.stddev_pop("prob"), 6).alias("std"), *q, F.round(F.max("prob"), 6).alias("max"))


@query("SELECT dataset, count(*) n, count(*) FILTER (WHERE hit) persisted FROM (SELECT p.dataset, p.t, p.y, p.x, EXISTS (SELECT 1 FROM peaks o WHERE o.dataset=p.dataset AND o.t=p.t+1 AND o.z=p.z AND abs(o.y-p.y)<=6 AND abs(o.x-p.x)<=6) hit FROM peaks p WHERE prob>0.98::double) GROUP BY 1")
def peak_persistence(spark, d):
    """High peaks with any peak near by in the next frame."""
    p = tracks.peaks(spark, d)
    after = p.select("dataset", (F.col("t") - 1).alias("t"), "z", F.col("y").alias("oy"), F.col("x").alias("ox"))
    high = p.where("prob > double(0.98)")
    hit = high.join(after, ["dataset", "t", "z"]).where("abs(oy - y) <= 6 AND abs(ox - x) <= 6").select(*AT).distinct().withColumn("hit", F.lit(1))
    return high.join(hit, AT, "left").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("persisted"))

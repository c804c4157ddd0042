"""Model queries: comparison, metrics, importance, ensemble, neighbours, batch prediction."""

import uuid

from pyspark.sql import functions as F

from ..operators import metrics
from ..plans import training
from ..plans.pipeline import train
from ..plans.policy import policy_for
from ..plans.repair import fit_repair
from ..session import shared_folder
from .registry import register, table

def _judged_documents(spark, folder):
    """Documents with a quality label, and plain measures of their text."""
    documents = table(spark, folder, "documents").selectExpr(
        "doc_id", "lang", "source", "n_chars", "length(text) - length(replace(text, ' ', '')) as n_blanks",
        "regexp_count(text, '[.!?]') as n_stops", "regexp_count(text, '[0-9]') as n_digits",
    )
    return documents.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


def _parts(spark, folder):
    return table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


def _classified(spark, folder, wanted, **options):
    return training.train_and_compare(_judged_documents(spark, folder), "quality", "doc_id", wanted, **options)


@register("model_compare")
def model_compare(spark, folder):
    return _classified(spark, folder, training.ALL).table(spark, "original")


@register("model_compare_regression")
def model_compare_regression(spark, folder):
    done = training.train_and_compare(_parts(spark, folder), "p_retailprice", "p_partkey", training.ALL)
    return done.table(spark, "original")


def _damaged_documents(spark, folder):
    """Judged documents with holes, outliers and a text column of blanks planted in them."""
    return _judged_documents(spark, folder).selectExpr(
        "doc_id", "lang", "if(doc_id % 5 = 0, null, source) as source", "if(doc_id % 7 = 0, null, n_chars) as n_chars",
        "if(doc_id % 11 = 0, n_blanks * 50, n_blanks) as n_blanks", "if(doc_id % 13 = 0, null, n_stops) as n_stops", "n_digits", "quality",
    )


@register("model_versions")
def model_versions(spark, folder):
    """The same model on a damaged table and on its repair, through the registry of results."""
    damaged = _damaged_documents(spark, folder)
    repaired = fit_repair(damaged, "quality", policy_for("balanced"), key="doc_id", readable=False).frame
    path = f"{shared_folder(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    train(damaged, repaired, "quality", "doc_id", path=path, wanted=training.TREE)
    both = training.registered_scores(spark, path)
    return both.groupBy("model", "metric").pivot("dataset", ["original", "repaired"]).agg(F.first("value"))


@register("feature_importance")
def feature_importance(spark, folder):
    return _classified(spark, folder, training.FOREST).whole().importance_table(spark)


@register("ensemble_top2")
def ensemble(spark, folder):
    done = _classified(spark, folder, [training.TREE, training.LOGISTIC]).whole()
    return training.first_predictions(done.trained[-1].predictions)


@register("tuned_tree")
def tuned_tree(spark, folder):
    done = training.train_and_compare(
        _parts(spark, folder), "p_retailprice", "p_partkey", training.TREE, search=True, validate=True
    )
    return done.table(spark, "original")


# A rule stands in for a model, so that the score arithmetic can be checked against SQL.
GUESS = "case when n_chars > 400 then 1 else 0 end"


@register(
    "classification_metrics",
    f"""with g as (select quality as a, {GUESS} as p from documents join labels using (doc_id)),
    k as (select c, (select count(*) from g where a = c) as actual, (select count(*) from g where p = c) as guessed,
      (select count(*) from g where a = c and p = c) as hit from (select a as c from g union select p from g)),
    s as (select actual, hit, case when guessed > 0 then hit / guessed::double else 0 end as pr,
      case when actual > 0 then hit / actual::double else 0 end as re from k)
    select round(sum(hit) / sum(actual)::double, 6) as accuracy, round(sum(actual * pr) / sum(actual), 6) as precision,
    round(sum(actual * re) / sum(actual), 6) as recall,
    round(sum(actual * case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end) / sum(actual), 6) as f1 from s""",
)
def classification_metrics(spark, folder):
    judged = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    scored = judged.selectExpr("quality as label", f"{GUESS} as prediction")
    return metrics.classification_metrics(scored).select(
        *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    )


@register(
    "regression_metrics",
    """with g as (select l_extendedprice as y, 1500 + l_quantity * 2000 as p from lineitem)
    select round(avg(abs(y - p)), 4) as mae, round(avg((y - p) * (y - p)), 2) as mse,
    round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) as r2 from g""",
)
def regression_metrics(spark, folder):
    guessed = table(spark, folder, "lineitem").selectExpr("l_extendedprice as label", "1500 + l_quantity * 2000 as prediction")
    return metrics.regression_metrics(guessed).select(
        F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"), F.round("r2", 6).alias("r2")
    )


@register(
    "knn_classifier",
    """with e as (select vec_id, label, embedding::double[] as v from embeddings),
    n as (select a.vec_id, a.label, b.label as near_label, row_number() over (partition by a.vec_id order by
      list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.label) as place
      from e a join e b on a.vec_id % 5 = 0 and b.vec_id % 5 <> 0 qualify place <= 5)
    select vec_id as key, label, near_label as prediction from
      (select vec_id, label, near_label, count(*) as c from n group by all)
    qualify row_number() over (partition by vec_id order by c desc, near_label) = 1""",
)
def knn_classifier(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("key"), "label", F.col("embedding").cast("array<double>").alias("vec")
    )
    return training.knn_predict(rows.filter("key % 5 <> 0"), rows.filter("key % 5 = 0"), "classification")

"""Features, models, evaluation and prediction."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import categories as CAT
from tablewright.operators import features as X
from tablewright.operators import kernels as K
from tablewright.operators.evaluation import eval_classification as report
from tablewright.operators.evaluation import eval_regression as errors
from tablewright.operators.models import select_model as choose
from tablewright.operators.models import train_test_split as split
from tablewright.plans import prediction as P

from . import query, rounded, table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def split_xy(spark, sf):
    features, _ = X.split_xy(table(spark, sf, "part"), "p_retailprice")
    return features


@query("SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label FROM customer")
def label_encode(spark, sf):
    return X.label_encode(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(
    """SELECT kind, "column", position FROM (VALUES ('numeric', 'event_id', 0), ('numeric', 'user_id', 1),
         ('numeric', 'value', 2), ('categorical', 'event_type', 0), ('categorical', 'props', 1), ('ignored', 'ts', 0))
       AS t(kind, "column", position)"""
)
def feature_types(spark, sf):
    from tablewright.plans.preprocess import preprocess

    kinds = X.feature_types(preprocess(table(spark, sf, "events")))
    rows = [(k, c, i) for k in ("numeric", "categorical", "ignored") for i, c in enumerate(getattr(kinds, k))]
    return spark.createDataFrame(rows, "kind string, column string, position int")


@query(
    """SELECT p_partkey, coalesce(nullif(p_size, 7)::DOUBLE, (SELECT median(nullif(p_size, 7)) FROM part)) AS p_size
       FROM part"""
)
def impute_median(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size"))
    return X.impute_median(parts, ["p_size"])


@query(
    """SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) + 0.0
              AS p_retailprice, 0.0::DOUBLE AS one FROM part"""
)
def standard_scale(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.lit(1).alias("one"))
    scaled = X.standard_scale(parts, ["p_retailprice", "one"])
    return scaled.withColumn("p_retailprice", rounded("p_retailprice"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'missing') AS o_orderstatus FROM orders")
def impute_constant(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus")
    )
    return X.impute_constant(orders, ["o_orderstatus"])


@query(
    "SELECT c_custkey, "
    + ", ".join(f"""(c_mktsegment = '{s}')::INTEGER AS "c_mktsegment={s}" """ for s in SEGMENTS)
    + " FROM customer"
)
def one_hot(spark, sf):
    return X.one_hot(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]
_SCALED = ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS f{i}" for i, c in enumerate(_NUMBERS)
)
_FLAGS = ", ".join(f"(c_mktsegment = '{s}')::INTEGER::DOUBLE AS f{i + 3}" for i, s in enumerate(SEGMENTS))


@query(f"SELECT c_custkey, {_SCALED}, {_FLAGS} FROM customer")
def assemble(spark, sf):
    vectors = X.assemble(table(spark, sf, "customer").drop("c_name"))
    values = vectors.select("c_custkey", vector_to_array("features").alias("v"))
    width = len(_NUMBERS) + len(SEGMENTS)
    return values.select("c_custkey", *[rounded(F.get("v", F.lit(i))).alias(f"f{i}") for i in range(width)])


@query(
    """WITH codes AS (
        SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS name,
               dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS segment FROM customer),
    sizes AS (SELECT count(DISTINCT c_name) AS names, count(DISTINCT c_mktsegment) AS segments FROM customer)
    SELECT c_custkey, (names + segments)::INTEGER AS size, name::INTEGER AS first,
           (names + segment)::INTEGER AS second, 2 AS ones
    FROM codes, sizes"""
)
def encode_categories(spark, sf):
    """Categories of any number: the index is joined, the vector sparse."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    encoded = CAT.encode_categories(customers, ["c_name", "c_mktsegment"])
    parts = encoded.select("c_custkey", CAT.sparse_parts(F.col("categories")).alias("p"))
    ones = F.aggregate("p.values", F.lit(0.0), lambda s, x: s + x).cast("int")
    places = [F.get("p.indices", F.lit(i)).alias(name) for i, name in enumerate(("first", "second"))]
    return parts.select("c_custkey", "p.size", *places, ones.alias("ones"))


@query(
    """SELECT *, CASE WHEN row_number() OVER (ORDER BY substr(md5(o_orderkey::VARCHAR || '|42'), 1, 15))
                           <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part FROM orders"""
)
def train_test_split(spark, sf):
    train, test = split(table(spark, sf, "orders"), key="o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("SELECT * FROM orders")
def train_test_split_whole(spark, sf):
    """The two parts together are the table, each row once."""
    train, test = split(table(spark, sf, "orders"))
    return train.unionByName(test)


_CHOICES = """SELECT task, source, n AS rows,
       CASE WHEN n <= 1000 THEN small WHEN n <= 10000 THEN middle ELSE large END AS model
    FROM (VALUES ('classification', 'LinearSVC', 'RandomForestClassifier', 'GBTClassifier'),
                 ('regression', 'LinearRegression', 'RandomForestRegressor', 'GBTRegressor'))
         AS t(task, small, middle, large),
         (SELECT 'labels' AS source, count(*) AS n FROM labels UNION ALL SELECT 'part', count(*) FROM part
          UNION ALL SELECT 'lineitem', count(*) FROM lineitem)"""


@query(_CHOICES)
def select_model(spark, sf):
    rows = []
    for source in ("labels", "part", "lineitem"):
        n = table(spark, sf, source).count()
        for task in ("classification", "regression"):
            rows.append((task, source, n, type(choose(task, n)).__name__))
    return spark.createDataFrame(rows, "task string, source string, rows bigint, model string")


@query(
    """WITH p AS (SELECT quality::VARCHAR AS label, (1 - toxic)::VARCHAR AS prediction FROM labels),
       k AS (SELECT c AS class, count(*) FILTER (label = c AND prediction = c) AS hits,
                    count(*) FILTER (prediction = c) AS predicted, count(*) FILTER (label = c) AS support
             FROM p, (VALUES ('0'), ('1')) AS v(c) GROUP BY c),
       s AS (SELECT class, hits / predicted AS precision, hits / support AS recall, hits, support,
                    2.0 * hits / (predicted + support) AS f1 FROM k)
       SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s
       UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), sum(support)::BIGINT FROM s
       UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                        sum(support)::BIGINT FROM s
       UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                        sum(support)::BIGINT FROM s"""
)
def eval_classification(spark, sf):
    pairs = table(spark, sf, "labels").selectExpr("quality AS label", "1 - toxic AS prediction")
    return report(pairs).withColumns({c: rounded(c) for c in ("precision", "recall", "f1")})


@query(
    """SELECT round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) ** 2), 6) AS mse,
              round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n
       FROM (SELECT p_retailprice AS y, 900.0 + p_size AS p FROM part)"""
)
def eval_regression(spark, sf):
    pairs = table(spark, sf, "part").selectExpr("p_retailprice AS label", "900.0D + p_size AS prediction")
    return errors(pairs).withColumns({c: rounded(c) for c in ("mae", "mse", "r2")})


_WEIGHTS, _PHASES = K.draw(2, 0.5, 3)
_FOURIER = ", ".join(
    f"round(sqrt(2.0 / 3) * cos({float(w[0])!r} * a + {float(w[1])!r} * b + {float(p)!r}), 6) + 0.0 AS z{i}"
    for i, (w, p) in enumerate(zip(_WEIGHTS.T, _PHASES, strict=True))
)


@query(f"SELECT p_partkey, {_FOURIER} FROM (SELECT p_partkey, p_size / 50.0 AS a, p_retailprice / 1000.0 AS b FROM part)")
def fourier_features(spark, sf):
    """Features of a radial basis kernel with gamma 0.5 for two columns."""
    parts = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0).alias("v"))
    mapped = K.fourier_features(parts.withColumn("v", array_to_vector("v")), "v", gamma=0.5, features=3).transform(
        parts.withColumn("v", array_to_vector("v"))
    )
    values = mapped.withColumn("v", vector_to_array("v"))
    return values.select("p_partkey", *[rounded(F.get("v", F.lit(i))).alias(f"z{i}") for i in range(3)])


@query()
def class_probabilities(spark, sf):
    """The chance of each quality for every labelled document, by the small classifier."""
    labels = _labels(spark, sf)
    predictor, _ = P.fit_predict(labels, "quality", "classification", model="small")
    found = P.probabilities(predictor, labels.drop("quality"))
    return found.select("doc_id", F.explode("probabilities").alias("p")).select("doc_id", "p.class", rounded("p.probability").alias("probability"))


def _lines(df, columns):
    """The table's own feature columns as comma-separated texts."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat_ws(",", *fields).alias("line"))


def _labels(spark, sf):
    return table(spark, sf, "labels")


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")


def _parts(spark, sf):
    return table(spark, sf, "part").drop("p_name")


def _lineitems(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )


@query()
def model_small_classifier(spark, sf):
    return P.evaluate(*P.fit_predict(_labels(spark, sf), "quality", "classification", model="small"))


@query()
def model_small_regressor(spark, sf):
    return P.evaluate(*P.fit_predict(_labels(spark, sf), "quality", "regression", model="small"))


@query()
def model_middle_classifier(spark, sf):
    return P.evaluate(*P.fit_predict(_customers(spark, sf), "c_mktsegment", "classification"))


@query()
def model_middle_regressor(spark, sf):
    return P.evaluate(*P.fit_predict(_parts(spark, sf), "p_retailprice", "regression"))


@query()
def model_large_classifier(spark, sf):
    return P.evaluate(*P.fit_predict(_lineitems(spark, sf), "l_linestatus", "classification"))


@query()
def model_large_regressor(spark, sf):
    return P.evaluate(*P.fit_predict(_lineitems(spark, sf), "l_extendedprice", "regression"))


@query()
def predict_rows(spark, sf):
    labels = _labels(spark, sf)
    predictor, _ = P.fit_predict(labels, "toxic", "regression")
    return P.predict_rows(predictor, _lines(labels, ["doc_id", "quality"]))


@query(
    """SELECT c_mktsegment AS category, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code
       FROM (SELECT DISTINCT c_mktsegment FROM customer)"""
)
def label_mapping(spark, sf):
    customers = table(spark, sf, "customer").select("c_acctbal", "c_mktsegment")
    predictor, _ = P.fit_predict(customers, "c_mktsegment", "regression", model="small")
    return P.label_mapping(predictor)


@query()
def prediction(spark, sf):
    labels = _labels(spark, sf)
    done = P.prediction(labels, "toxic", "classification", _lines(labels, ["doc_id", "quality"]))
    return done.predictions

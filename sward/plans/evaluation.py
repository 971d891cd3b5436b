"""Cross-validation, training and prediction jobs."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from sward.operators import metrics as M
from sward.operators import models
from sward.operators.features import to_vector
from sward.operators.folds import split_fold
from sward.plans.preprocess import (
    base_transforms, preprocess_fold, preprocess_prediction, preprocess_training,
)
from sward.sources import readers, writers


def class_total(rows):
    """Number of classes: ids are dense, so one more than the largest."""
    return int(rows.agg(F.max("label_id")).first()[0]) + 1


def fold_pairs(rows, tagged, fold):
    """Training and test pairs ``(rows, features)`` of one fold; features carry their fold."""
    return zip(split_fold(rows, fold), [f.drop("fold") for f in split_fold(tagged, fold)])


def fold_scores(rows, tagged, layout, cfg, fold, n_classes, endangered=None):
    """Scored test rows of one fold."""
    train, test = fold_pairs(rows, tagged, fold)
    fitted, judged, shape = preprocess_fold(train, test, layout, cfg.preprocess, endangered)
    vectors = to_vector(*fitted, shape.size).persist()
    model = models.fit(vectors, cfg.model, shape.size, n_classes)
    vectors.unpersist()
    return model.transform(to_vector(*judged, shape.size))


def cross_validate(rows, features, layout, cfg, endangered=None):
    """Accuracy per fold: ``(fold, accuracy)``.

    Each fold is fitted on the others and scored once.  Features get their fold once and are kept
    partitioned by row, so a fold is a filter without a join.  A few folds run at the same time;
    only one number per fold comes back to the driver.
    """
    return cross_validate_variants(rows, features, layout, [cfg], endangered)[0]


def cross_validate_variants(rows, features, layout, cfgs, endangered=None):
    """``cross_validate`` of each of ``cfgs``, in their order.

    Variants with the same base transforms share the kept rows and features.  The folds of all variants wait in one
    queue, so that none waits for the last fold of the variant before; as many run at once as the first allows.
    """
    rows = rows.persist()
    n_classes, tagged = class_total(rows), {}
    for cfg in cfgs:
        base = _base(cfg)
        if base not in tagged:
            own = base_transforms(features, layout, cfg.preprocess)
            tagged[base] = own.join(rows.select("row_id", "fold"), "row_id").persist()

    def run(task):
        cfg, fold = task
        scored = fold_scores(rows, tagged[_base(cfg)], layout, cfg, fold, n_classes, endangered)
        result = M.topk_accuracy(
            scored, cfg.k, cfg.average, scores=models.score_column(scored)
        ).first()
        return fold, None if result is None else result["accuracy"]

    tasks = [(cfg, fold) for cfg in cfgs for fold in range(cfg.n_folds)]
    with ThreadPoolExecutor(cfgs[0].parallel) as pool:
        found = iter(list(pool.map(run, tasks)))
    rows.unpersist()
    for own in tagged.values():
        own.unpersist()
    spark = rows.sparkSession
    return [spark.createDataFrame([next(found) for _ in range(cfg.n_folds)], "fold int, accuracy double") for cfg in cfgs]


def _base(cfg):
    """What ``base_transforms`` depends on."""
    return cfg.preprocess.rank, cfg.preprocess.binarization, cfg.preprocess.normalization


def evaluate(rows, features, layout, cfg, endangered=None):
    """Mean, sample standard deviation and best fold of the cross-validation."""
    return M.cv_summary(cross_validate(rows, features, layout, cfg, endangered))


def train(rows, features, layout, cfg, path=None, endangered=None):
    """Fit on all rows; returns the model, the scaler and the training accuracy.

    With ``path`` the model and the scaler are stored under it.
    """
    n_classes = class_total(rows)
    rows, features, shape, scaler = preprocess_training(
        rows, features, layout, cfg.preprocess, endangered
    )
    vectors = to_vector(rows, features, shape.size).persist()
    model = models.fit(vectors, cfg.model, shape.size, n_classes)
    scored = model.transform(vectors)
    accuracy = M.topk_accuracy(scored, cfg.k, cfg.average, scores=models.score_column(scored))
    accuracy = accuracy.first()["accuracy"]
    if path is not None:
        writers.save_model(model, f"{path}/model")
        if scaler is not None:
            writers.save_encoder(scaler, f"{path}/scaler")
    vectors.unpersist()
    return model, scaler, accuracy


def load_trained(spark, path, cfg):
    """Model and scaler stored by ``train``."""
    scaler = None
    if cfg.preprocess.standardization:
        scaler = readers.load_encoder(spark, f"{path}/scaler")
    return readers.load_model(f"{path}/model"), scaler


def predict(model, rows, features, layout, cfg, encoder, scaler=None, key="row_id"):
    """Decoded best class of each row with its score: ``(plot_id, prediction, score)``."""
    features, shape = preprocess_prediction(features, layout, cfg.preprocess, scaler)
    scored = model.transform(to_vector(rows, features, shape.size))
    column = models.score_column(scored)
    if column == "rawPrediction":
        raw = M.vector_to_array(F.col(column))
        scored = scored.withColumn("probability", M.softmax(raw))
    best = M.top_class(scored.drop("prediction"), encoder=encoder)
    return best.select(F.col(key).alias("plot_id"), "prediction", "score")

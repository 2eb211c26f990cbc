"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.functions import scores as S
from modlens.functions import text as T
from modlens.functions.stemming import stem_table
from modlens.operators import combine, embed, ensemble, evaluate, models, pos, reduce as reduction, resample, search
from modlens.operators import select, split, trees, vectorize
from modlens.operators.sentiment import lexicon_hits, sentiment_features
from modlens.operators.topics import TopicModel, TopicParams
from modlens.sources import tables
from modlens.sources.tables import materialise, settle, spread, table
from modlens.streaming import scoring

SEED = 42
LEX = S.LEXICAL
MODELS = ["brevity", "density", "lexicon"]
VOCAB = vectorize.TfidfParams(1000, 3, 0.9, (1, 1))
POOLED_TERMS = vectorize.TfidfParams(None, 2, 0.9, (1, 1))


def r6(col):
    """Six decimals without a negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


# Inputs -------------------------------------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Text of labelled documents with their labels."""
    return documents(spark, d).join(labels(spark, d), "doc_id")


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.preprocess(F.col("text")).alias("clean"))


def labelled_lexical(spark: SparkSession, d: str) -> DataFrame:
    docs = labelled(spark, d)
    return S.lexical_features(docs, keep=["toxic", "quality"])


def lexical_table(spark: SparkSession, d: str) -> DataFrame:
    """The same, written once, for statistics that scan it more than once."""
    return materialise(labelled_lexical(spark, d), "lexical", even=True)


def clean_table(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned text, written once: fitting and applying a model then share the cleaning."""
    return materialise(cleaned(spark, d), "clean")


def binary_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as ``(id, x, y)``; label 0 is the minority class."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") == 0).cast("int").alias("y"),
    )


def fixed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Three deterministic scorers of the labelled documents: ``(model, doc_id, label, p)``."""
    docs = labelled(spark, d)
    counted = docs.select(
        "doc_id",
        F.col("toxic").alias("label"),
        lexicon_hits(F.col("text")).cast("double").alias("hits"),
        F.size(T.vector_terms(F.col("text"))).cast("double").alias("n"),
    )
    hits, n = F.col("hits"), F.col("n")
    p = {
        "lexicon": F.least(F.lit(1.0), hits / 3.0),
        "density": F.least(F.lit(1.0), F.coalesce(F.try_divide(hits * 20.0, n), F.lit(0.0))),
        "brevity": F.lit(1.0) / (n / 100.0 + 1.0),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("model"), p[m].alias("p")) for m in MODELS])
    return counted.select("doc_id", "label", F.inline(rows)).select("model", "doc_id", "label", "p")


def score_table(spark: SparkSession, d: str) -> DataFrame:
    """The fixed scores, written once, for evaluations that scan them more than once."""
    return materialise(fixed_scores(spark, d), "scores", even=True)


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """Feature vectors of labelled documents, written once: fits scan them many times."""
    docs = labelled(spark, d)
    rows = scoring.stream_features(docs.select("doc_id", "text")).join(labels(spark, d), "doc_id")
    return materialise(models.assemble(rows, scoring.STREAM_FEATURES, "toxic", extra=["quality"]), "feature-rows", even=True)


# Sources, splits, samples --------------------------------------------------------------------------


def read_labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(labels(spark, d), "doc_id")


def target_select(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return tables.with_target(docs, labels(spark, d), "toxic")


def head_n(spark, d):
    return tables.head(table(spark, d, "documents").select("doc_id", "n_chars"), 100)


def label_balance(spark, d):
    parts = [
        split.label_balance(labels(spark, d), c).select(F.lit(c).alias("label"), F.col(c).alias("value"), "n")
        for c in ("toxic", "quality")
    ]
    return reduce(DataFrame.unionByName, parts)


def stratified_split(spark, d):
    return split.train_validation(labels(spark, d).select("doc_id", "toxic"), ["toxic"])


def any_label_split(spark, d):
    return split.split_any_label(labels(spark, d).select("doc_id", "toxic"))


def stratified_sample(spark, d):
    return split.stratified_sample(labels(spark, d).select("doc_id", "toxic"), ["toxic"], 0.3)


def random_split(spark, d):
    return split.train_validation(table(spark, d, "documents").select("doc_id"))


def capped_sample(spark, d):
    return split.capped_sample(table(spark, d, "documents").select("doc_id", "n_chars"))


def stratified_folds(spark, d):
    return split.add_folds(labels(spark, d).select("doc_id", "toxic"), ["toxic"])


def examples_per_class(spark, d):
    return split.examples_per_class(labels(spark, d).select("doc_id", "toxic"), "toxic")


# Text ---------------------------------------------------------------------------------------------


def strip_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_urls(F.col("html")).alias("html"))


def strip_mentions(spark, d):
    return documents(spark, d).select("doc_id", T.strip_mentions(F.lower("text")).alias("text"))


def tokens(spark, d):
    t = T.treebank_tokens(F.col("text"))
    return documents(spark, d).select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


def stopwords_removed(spark, d):
    options = T.CleanOptions(lemmatization=False)
    return documents(spark, d).select("doc_id", T.preprocess(F.col("text"), options).alias("kept"))


def noun_lemmas(spark, d):
    options = T.CleanOptions(lemmatization=False)
    words = documents(spark, d).select(F.explode(T.preprocess_tokens(F.col("text"), options)).alias("word")).distinct()
    return words.select("word", F.get(T.lemmatise(F.array("word")), F.lit(0)).alias("lemma")).filter("word <> lemma")


def stemmed_text(spark, d):
    """Cleaning with stems instead of the words."""
    options = T.CleanOptions(stemming=True)
    return documents(spark, d).select("doc_id", T.preprocess(F.col("text"), options).alias("stemmed"))


def preview_text(spark, d):
    return documents(spark, d).select(
        "doc_id", T.preview(F.col("text"), 50).alias("short"), T.preview(F.col("text"), 100).alias("long")
    )


def porter_stems(spark, d):
    return stem_table(documents(spark, d).select(F.explode(T.vector_terms(F.col("text"))).alias("word")))


def clean_turns(spark, d):
    """Cleaned text and lexical size of every conversation turn."""
    turns = table(spark, d, "conversations")
    return turns.select("conv_id", "turn", "role", T.preprocess(F.col("text")).alias("clean"))


# Vectorisers ---------------------------------------------------------------------------------------


def terms(spark, d, ngram_range=(1, 1)):
    return vectorize.terms_of(cleaned(spark, d), "clean", "doc_id", ngram_range)


def bag_of_words(spark, d):
    return vectorize.bag_of_words(terms(spark, d))


def doc_frequency(spark, d):
    return vectorize.document_frequency(terms(spark, d))


def ngram_counts(spark, d):
    return vectorize.document_frequency(terms(spark, d), (1, 3)).filter("df >= 2")


def vocabulary(spark, d):
    table_ = vectorize.vocabulary(terms(spark, d), vectorize.FULL_JOB, vectorize.FULL_JOB.ngram_range)
    return rounded(table_, "idf").withColumn("idx", F.col("idx").cast("bigint"))


def tfidf(spark, d):
    docs = clean_table(spark, d)
    model = vectorize.TfidfModel.fit(docs, "clean", VOCAB)
    return rounded(vectorize.tfidf_entries(model, docs, "clean"), "weight")


def tfidf_transform_holdout(spark, d):
    """Fit on the training part only, apply to the rest."""
    parts = split.train_validation(clean_table(spark, d))
    model = vectorize.TfidfModel.fit(parts.filter("part = 'train'"), "clean", VOCAB)
    return rounded(vectorize.tfidf_entries(model, parts.filter("part = 'validation'"), "clean"), "weight")


# Scalar families -----------------------------------------------------------------------------------


def lexical_features(spark, d):
    return rounded(S.lexical_features(documents(spark, d)), "avg_word_len", "avg_sentence_len", "type_token_ratio")


def lexical_by_class(spark, d):
    rows = labelled_lexical(spark, d)
    return rows.groupBy("toxic").agg(
        F.count("*").alias("n"), *[r6(F.avg(c)).alias(f"mean_{c}") for c in LEX]
    )


def pos_shares(spark, d):
    out = pos.pos_features(documents(spark, d))
    return rounded(out, *[c for c in out.columns if c != "doc_id"])


def tag_lexicon(spark, d):
    rows = pos.token_rows(documents(spark, d), "text", "doc_id").filter("word is not null")
    return pos.learn_tags(pos.tagged(rows, pos.starter_tags(spark)))


def sentiment_scores(spark, d):
    return sentiment_features(documents(spark, d))


def sentiment_turns(spark, d):
    """Sentiment of every conversation turn, averaged by role."""
    turns = table(spark, d, "conversations").withColumn("turn_id", F.concat_ws("|", "conv_id", "turn"))
    scored = sentiment_features(turns, "text", "turn_id").join(turns.select("turn_id", "role"), "turn_id")
    return scored.groupBy("role").agg(
        F.count("*").alias("n"), r6(F.avg("sent_compound")).alias("compound"), r6(F.avg("sent_neg")).alias("negative")
    )


def readability_scores(spark, d):
    return rounded(S.readability_features(documents(spark, d)), *S.READABILITY)


def syllables(spark, d):
    plain = T.strip_punctuation(F.lower("text"))
    words = documents(spark, d).select(F.explode(T.split_spaces(plain)).alias("word")).distinct()
    return words.select("word", F.get(S.vowel_groups(F.array("word")), F.lit(0)).cast("bigint").alias("n_syllables"))


# Embeddings and topics -----------------------------------------------------------------------------


def fixed_vectors(spark, d, docs):
    """Embedding rows used as word vectors: term number i takes the vector with id i."""
    vocab = vectorize.vocabulary(vectorize.terms_of(docs, "clean", "doc_id"), POOLED_TERMS)
    vecs = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("idx"), array_to_vector(F.col("embedding").cast("array<double>")).alias("vector")
    )
    return vocab.join(vecs, "idx").select(F.col("term").alias("word"), "vector")


def mean_pooled_vectors(spark, d):
    docs = clean_table(spark, d)
    words = vectorize.terms_of(docs, "clean", "doc_id")
    pooled = embed.mean_pool(words, "terms", fixed_vectors(spark, d, docs), 64)
    return pooled.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value")
    )


def _token_docs(spark, d):
    return materialise(cleaned(spark, d).select("doc_id", T.split_spaces(F.col("clean")).alias("tokens")), "tokens")


def word2vec_docs(spark, d):
    docs = _token_docs(spark, d)
    return embed.WordEmbedding.fit(docs, "tokens", embed.Word2VecParams()).transform(docs, "tokens")


def als_doc_embeddings(spark, d):
    docs = _token_docs(spark, d)
    return embed.FactorEmbedding.fit(docs, "tokens", embed.FactorParams()).transform(docs, "tokens")


def subword_embeddings(spark, d):
    docs = _token_docs(spark, d)
    return embed.SubwordEmbedding.fit(docs, "tokens", embed.SubwordParams()).transform(docs, "tokens")


def _topics(spark, d):
    docs = clean_table(spark, d)
    return docs, TopicModel.fit(docs, "clean", TopicParams())


def lda_topics(spark, d):
    docs, model = _topics(spark, d)
    return model.transform(docs, "clean")


def topic_terms(spark, d):
    return _topics(spark, d)[1].top_terms(spark)


# Combination and selection -------------------------------------------------------------------------


def feature_layout(spark, d):
    docs = documents(spark, d)
    config = combine.FeatureConfig(tfidf=VOCAB)
    model = combine.FeatureExtractor(config).fit(docs, include=["tfidf", *combine.SCALAR_FAMILIES])
    return model.layout(spark)


def combined_scalar_features(spark, d):
    config = combine.FeatureConfig(pos_input=combine.RAW)
    out = combine.scalar_features(documents(spark, d), config=config)
    return rounded(out, *[c for c in out.columns if c != "doc_id" and dict(out.dtypes)[c] == "double"])


def fitted_features(spark, d):
    """Every family fitted on the training part and applied to the validation part."""
    parts = split.train_validation(documents(spark, d))
    model = combine.FeatureExtractor(combine.FeatureConfig()).fit(parts.filter("part = 'train'"))
    return model.transform(parts.filter("part = 'validation'")).select("doc_id", vector_to_array("features").alias("features"))


def chi2_scores(spark, d):
    return rounded(select.chi2_scores(labelled_lexical(spark, d), LEX, "toxic"), "score")


def anova_f_scores(spark, d):
    return rounded(select.anova_f_scores(lexical_table(spark, d), LEX, "toxic"), "score")


def mutual_info_scores(spark, d):
    return rounded(select.mutual_info_scores(lexical_table(spark, d), LEX, "toxic"), "score")


def top_chi2_features(spark, d):
    scores = select.chi2_scores(labelled_lexical(spark, d), LEX, "toxic")
    return rounded(select.top_features(scores, 5), "score")


def correlated_pairs(spark, d):
    return rounded(select.correlated_pairs(lexical_table(spark, d), LEX), "r")


def normality_k2(spark, d):
    long = table(spark, d, "embeddings").select(
        F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "value")
    )
    return rounded(select.normality(long.withColumn("feature", F.col("feature").cast("bigint"))), "k2", "p")


def class_densities(spark, d):
    rows = select.class_densities(lexical_table(spark, d), LEX, "toxic")
    return rounded(rows, "at", "density").withColumn("i", F.col("i").cast("bigint"))


def coef_cull(spark, d):
    rows = labelled_lexical(spark, d)
    coefficients = settle(select.label_correlations(rows, LEX, "toxic"))
    kept = select.cull(coefficients, LEX, 0.05)
    return rounded(coefficients.join(kept.mask(spark), "feature").select("feature", "coefficient", "kept"), "coefficient")


def elasticnet_select(spark, d):
    rows = lexical_table(spark, d)
    result = select.elastic_net_selection(rows, LEX, "toxic", 0.001)
    return result.coefficients.join(result.selection.mask(spark), "feature").select(
        "feature", "coefficient", "kept", F.lit(result.alpha).alias("alpha"), F.lit(result.l1_ratio).alias("l1_ratio"),
        F.lit(result.holdout_mse).alias("holdout_mse"),
    )


def l1_select(spark, d):
    rows = lexical_table(spark, d)
    return select.l1_selection(rows, LEX, "toxic", max_iter=25).mask(spark)


def holdout_mse(spark, d):
    return fixed_scores(spark, d).groupBy("model").agg(
        r6(F.avg((F.col("label") - F.col("p")) * (F.col("label") - F.col("p")))).alias("mse")
    )


# Scaling, reduction, resampling --------------------------------------------------------------------


def standardise(spark, d):
    rows = binary_vectors(spark, d)
    scaled = reduction.Scaler.fit(rows).transform(rows)
    return scaled.select("id", F.posexplode("x").alias("dim", "z")).select(
        "id", F.col("dim").cast("bigint").alias("dim"), r6("z").alias("z")
    )


def balanced_weights(spark, d):
    rows = labels(spark, d).select("doc_id", "toxic")
    return rounded(models.balanced_weight(rows, "toxic"), "weight")


def _undersample(ratio, spark, d):
    return resample.undersample(binary_vectors(spark, d), ratio).select("id", "y")


def knn_minority(spark, d):
    return rounded(resample.minority_neighbours(binary_vectors(spark, d)), "dist")


def borderline_danger(spark, d):
    return resample.danger_rows(binary_vectors(spark, d))


def adasyn_quota(spark, d):
    return rounded(resample.adasyn_quota(binary_vectors(spark, d)), "share")


def tomek_links(spark, d):
    return resample.tomek_links(binary_vectors(spark, d))


def smote_points(spark, d):
    points = resample.smote_points(binary_vectors(spark, d))
    return points.select("seed_id", "copy_no", "neighbour_id", F.posexplode("x").alias("dim", "value")).select(
        "seed_id", "copy_no", "neighbour_id", F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value")
    )


def resampled_sizes(spark, d):
    """Class sizes after each resampling method. Methods run one after another, so that the shuffles of one are there
    at a time."""
    rows, parts = materialise(binary_vectors(spark, d), "vectors"), []
    with tables.shuffles_freed(spark):
        for m in resample.METHODS:
            sizes = resample.resample(rows, m).groupBy("y").agg(F.count("*").alias("n"))
            parts.append(materialise(sizes.select(F.lit(m).alias("method"), "y", "n"), "sizes"))
    tables.release(spark, rows)
    return reduce(DataFrame.unionByName, parts)


def pca_project(spark, d):
    rows = binary_vectors(spark, d)
    return reduction.PcaReducer.fit(rows, 8).transform(rows).select("id", F.col("x").alias("components"))


def pca_component_search(spark, d):
    rows = split.add_folds(binary_vectors(spark, d), ["y"], id_col="id")
    return reduction.find_components(rows).scores


def resampling_contest(spark, d):
    from modlens.plans.training import resampling_contest as contest

    parts = materialise(split.train_validation(binary_vectors(spark, d), ["y"], id_col="id"), "contest")
    train, test = parts.filter("part = 'train'").drop("part"), parts.filter("part = 'validation'").drop("part")
    return contest(train, test, fraction=1.0)[0]


# Models --------------------------------------------------------------------------------------------


def _fit_and_score(trainer, name, spark, d):
    """Train on the training part, score the validation part."""
    parts = split.train_validation(feature_rows(spark, d), ["label"])
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'validation'")
    return models.score(trainer(materialise(train, "train", even=True)), test, name=name)


def logreg_multilabel(spark, d):
    rows = feature_rows(spark, d).withColumn("toxic", F.col("label")).withColumn("x", vector_to_array("features"))
    names = scoring.STREAM_FEATURES
    wide = rows.select("doc_id", "toxic", "quality", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    _, scored = models.multilabel(wide, names, ["toxic", "quality"], partial(models.logistic, balanced=True, max_iter=50))
    return scored(wide)


# Cuts of the one-tree queries: (feature, width, number of cuts), a cut at every multiple of the width.
GRID = (("chars", 100, 200), ("spaces", 20, 200), ("commas", 2, 100), ("letter_a", 1, 200))


def grid_rows(spark, d):
    """Vectors of counts of the labelled documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    rows = labelled(spark, d).select(
        "doc_id", "quality", F.length(text).cast("double").alias("chars"), count(" ").cast("double").alias("spaces"),
        count(",").cast("double").alias("commas"), count("a").cast("double").alias("letter_a"),
    )
    return models.assemble(rows, [name for name, *_ in GRID], "quality")


def _grid_tree(params, spark, d):
    """One regularised tree over a fixed grid of cuts, as the scores of all labelled documents."""
    rows = materialise(grid_rows(spark, d), "grid-rows", even=True)
    cuts = [[float(width * i) for i in range(n)] for _, width, n in GRID]
    return rounded(models.score(trees.boost(rows, params, cuts), rows), "p").select("doc_id", "label", "p")


def boosted_tree(spark, d):
    return _grid_tree(trees.BoostParams(rounds=1, max_depth=2), spark, d)


def leafwise_tree(spark, d):
    """Three leaves, best first, with counted rows instead of curvature as the limit."""
    params = trees.BoostParams(
        rounds=1, learning_rate=0.1, max_depth=6, max_leaves=3, reg_lambda=0.0, min_child_weight=1e-3, min_child_rows=20
    )
    return _grid_tree(params, spark, d)


def split_gains(spark, d):
    """Gain of every cut of the grid at the root."""
    cuts = [[float(width * i) for i in range(n)] for _, width, n in GRID]
    gains = trees.root_gains(grid_rows(spark, d), cuts, trees.BoostParams())
    names = F.array(*[F.lit(name) for name, *_ in GRID])
    steps = F.array(*[F.lit(width) for _, width, _ in GRID])
    named = gains.where("gain IS NOT NULL").select(
        F.get(names, F.col("feature")).alias("feature"), (F.get(steps, F.col("feature")) * F.col("bin")).cast("bigint").alias("cut"),
        F.col("nl").alias("n_left"), F.round("gain", 6).alias("gain"),
    )
    return rounded(named, "gain")


def halving_search(spark, d):
    rows = feature_rows(spark, d)
    return search.halving_search(rows, "random_forest", search.DEBUG_SPACES["random_forest"]).trace


def stacking(spark, d):
    rows = feature_rows(spark, d)
    members = {
        "logistic": models.logistic,
        "random_forest": models.random_forest,
    }
    return ensemble.stack(rows, members).score(rows)


def forest_importances(spark, d):
    rows = feature_rows(spark, d)
    model = models.random_forest(rows, n_estimators=10, max_depth=5)
    return evaluate.top_importances(models.importances(model, scoring.STREAM_FEATURES, "random_forest"))


def halving_schedule(spark, d):
    return search.schedule_table(labels(spark, d).agg(F.count("*").alias("n"))).withColumns(
        {c: F.col(c).cast("bigint") for c in ("rung", "rows", "candidates")}
    )


def candidate_survivors(spark, d):
    """Nine candidates (scorer at threshold), scored by F1 per fold; the best third goes on."""
    folds = split.add_folds(labels(spark, d).select("doc_id", "toxic"), ["toxic"]).select("doc_id", "fold")
    cuts = F.explode(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.6)))
    rows = fixed_scores(spark, d).join(folds, "doc_id").withColumn("cut", cuts)
    candidate = F.concat_ws("@", "model", F.col("cut").cast("string"))
    hit, y = F.col("p") >= F.col("cut"), F.col("label") == 1
    counts = rows.groupBy(candidate.alias("candidate"), "fold").agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn")
    )
    f1 = evaluate.div0(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))
    best = search.survivors(counts.select("candidate", F.round(f1, 9).alias("score")))
    return rounded(best, "score").withColumn("rank", F.col("rank").cast("bigint"))


def soft_vote(spark, d):
    return rounded(ensemble.soft_vote(fixed_scores(spark, d), MODELS), "p")


def weighted_vote(spark, d):
    scores = score_table(spark, d)
    weights = evaluate.eval_metrics(scores).select("model", F.col("f1").alias("weight"))
    return rounded(ensemble.weighted_vote(scores, settle(weights)), "p")


# Evaluation ----------------------------------------------------------------------------------------


def eval_metrics(spark, d):
    return rounded(evaluate.eval_metrics(score_table(spark, d)), "accuracy", "f1", "roc_auc")


def confusion(spark, d):
    return evaluate.confusion(fixed_scores(spark, d)).select("model", "label", "pred", "n")


def confusion_normalised(spark, d):
    return rounded(evaluate.confusion(fixed_scores(spark, d)), "row_share").select("model", "label", "pred", "row_share")


def class_report(spark, d):
    return rounded(evaluate.class_report(fixed_scores(spark, d)), "precision", "recall", "f1")


def macro_scores(spark, d):
    return rounded(evaluate.macro_scores(score_table(spark, d)), "f1", "precision", "recall", "accuracy")


def pr_curve(spark, d):
    return rounded(evaluate.pr_curve(score_table(spark, d)), "threshold", "precision", "recall")


def roc_curve(spark, d):
    return rounded(evaluate.roc_curve(score_table(spark, d)), "threshold", "fpr", "tpr")


def best_threshold(spark, d):
    return rounded(evaluate.best_thresholds(score_table(spark, d)), "threshold", "f1")


def best_overall(spark, d):
    return rounded(evaluate.best_overall(score_table(spark, d)), "threshold", "f1")


def errors_at_threshold(spark, d):
    scores = score_table(spark, d)
    return rounded(evaluate.errors_at(scores, evaluate.best_thresholds(scores)), "threshold")


def threshold_sweep(spark, d):
    return rounded(evaluate.threshold_sweep(fixed_scores(spark, d)), "f1", "precision", "recall")


def sweep_optima(spark, d):
    return evaluate.sweep_optima(evaluate.threshold_sweep(fixed_scores(spark, d)))


def best_model(spark, d):
    return rounded(evaluate.best_model(evaluate.eval_metrics(score_table(spark, d))), "f1")


def metrics_long(spark, d):
    return rounded(evaluate.metrics_long(evaluate.eval_metrics(score_table(spark, d))), "value")


def top_importances(spark, d):
    rows = lexical_table(spark, d)
    parts = [
        select.label_correlations(rows, LEX, label).select(
            F.lit(label).alias("model"), "feature", F.round(F.abs("coefficient"), 6).alias("importance")
        )
        for label in ("toxic", "quality")
    ]
    top = evaluate.top_importances(parts[0].unionByName(parts[1]).filter("importance is not null"), 5)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


def sample_predictions(spark, d):
    docs = labelled(spark, d).select("doc_id", F.col("toxic").alias("label"), T.preview(F.col("text"), 100).alias("text"))
    examples = split.examples_per_class(docs, "label")
    return rounded(evaluate.sample_predictions(examples, fixed_scores(spark, d)), "p")


def performance_at_threshold(spark, d):
    out = evaluate.performance_at(score_table(spark, d), 0.3)
    return rounded(out, "precision", "recall", "f1", "default_accuracy")


# Streaming -----------------------------------------------------------------------------------------


def stream_scoring(spark, d):
    """Train on the labelled documents, then score the document files as a stream."""
    return _streamed(spark, d, models.logistic(feature_rows(spark, d), max_iter=50))


def _streamed(spark, d, model):
    schema = table(spark, d, "documents").schema
    stream = scoring.read_documents(spark, f"{d}/documents.parquet", schema)
    output = tables.scratch_path(spark, "stream-scores")
    scoring.start_scoring(stream, model, f"{output}/rows", f"{output}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id bigint, p double, flagged int").parquet(f"{output}/rows")


def word_vector_invariants(spark, d):
    """Distinct words of the cleaned documents, and how many have a vector of the asked size without a hole."""
    docs = _token_docs(spark, d)
    vectors = embed.word_vectors(docs, "tokens").withColumn("v", vector_to_array("vector"))
    whole = (F.size("v") == 100) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    words = docs.select(F.explode("tokens").alias("word")).distinct().join(vectors, "word", "left")
    return words.agg(F.count("*").alias("words"), F.count_if(F.coalesce(whole, F.lit(False))).alias("with_vector"))


def saved_pipeline_scores(spark, d):
    """Families of each kind of state and a classifier fitted on the labelled documents, saved as one pipeline and
    loaded again: documents, and how many the loaded one scores as the first did, in a batch and in a stream."""
    train = labelled(spark, d)
    families = ["tfidf", "word2vec", *combine.SCALAR_FAMILIES, "topic"]
    model = combine.FeatureExtractor(combine.FeatureConfig()).fit(train, include=families)
    rows = materialise(model.transform(train), "train", even=True)
    rows = rows.join(labels(spark, d).select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
    fitted = combine.scoring_pipeline(model, models.logistic(materialise(rows, "train", even=True)))
    path = tables.scratch_path(spark, "pipeline")
    fitted.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    stream = scoring.read_documents(spark, f"{d}/documents.parquet", table(spark, d, "documents").schema)
    out = tables.scratch_path(spark, "pipeline-scores")
    scoring.start_pipeline_scoring(stream.select("doc_id", "text"), loaded, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    streamed = spark.read.parquet(f"{out}/rows").select("doc_id", F.col("p").alias("streamed"))
    batch = models.score(loaded, documents(spark, d)).withColumnRenamed("p", "batch")
    both = models.score(fitted, documents(spark, d)).join(batch, "doc_id").join(streamed, "doc_id")
    near = lambda c: F.count_if(F.abs(F.col("p") - F.col(c)) < 1e-6)
    return both.agg(F.count("*").alias("documents"), near("batch").alias("batch_equal"), near("streamed").alias("stream_equal"))


def registry_roundtrip(spark, d):
    """Models, votes and a stack saved and loaded again: labelled documents, and how many get the same score."""
    rows = feature_rows(spark, d)
    trainers = {"logistic": models.logistic, "random_forest": models.random_forest}
    stack = ensemble.stack(rows, trainers)
    fitted = stack.members
    ensembles = {"voting": ensemble.Voting(fitted), "weighted_voting": ensemble.Voting(fitted, {"logistic": 0.7, "random_forest": 0.4}), "stacking": stack}

    def scores(members, groups):
        return ensemble.member_scores(members, rows).unionByName(
            reduce(DataFrame.unionByName, [e.score(rows).select("model", "doc_id", "label", "p") for e in groups.values()])
        )

    before = materialise(scores(fitted, ensembles), "before")
    registry = tables.ModelRegistry(spark, tables.scratch_path(spark, "registry"))
    registry.save(fitted, evaluate.eval_metrics(before), ensembles, {"confusion": evaluate.confusion(before)})
    loaded, _ = registry.load()
    after = scores(loaded, registry.load_ensembles(loaded)).select("model", "doc_id", F.col("p").alias("again"))
    return before.join(after, ["model", "doc_id"]).groupBy("model").agg(
        F.count("*").alias("documents"), F.count_if(F.abs(F.col("p") - F.col("again")) < 1e-9).alias("equal")
    )


# Invariants of fitted models, which SQL can state although it cannot fit them -------------------------


def topic_invariants(spark, d):
    """Documents, and how many have non-negative topic shares that sum to one."""
    total = F.aggregate("topics", F.lit(0.0), lambda a, x: a + x)
    proper = (F.abs(total - 1) < 1e-6) & (F.array_min("topics") >= 0)
    return lda_topics(spark, d).agg(F.count("*").alias("documents"), F.count_if(proper).alias("proper"))


def stream_equals_batch(spark, d):
    """Documents, and how many the stream scores as the batch does."""
    model = models.logistic(feature_rows(spark, d), max_iter=50)
    batch = scoring.score_documents(documents(spark, d), model).select("doc_id", F.col("p").alias("batch"))
    both = _streamed(spark, d, model).join(batch, "doc_id")
    return both.agg(F.count("*").alias("documents"), F.count_if(F.abs(F.col("p") - F.col("batch")) < 1e-9).alias("equal"))


def pca_invariants(spark, d):
    """Pairs of principal components, and whether the projected rows are uncorrelated in them."""
    x = pca_project(spark, d).select(*[F.col("components")[i].alias(f"c{i}") for i in range(8)])
    pairs = [(i, j) for j in range(8) for i in range(j)]
    row = materialise(x, "projected").agg(*[F.corr(f"c{i}", f"c{j}").alias(f"r_{i}_{j}") for i, j in pairs])
    values = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"), (F.abs(f"r_{i}_{j}") < 1e-6).alias("uncorrelated"))
        for i, j in pairs
    ])
    return row.select(F.inline(values))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        read_labelled, target_select, head_n, label_balance, stratified_split, any_label_split, stratified_sample,
        random_split, capped_sample, stratified_folds, examples_per_class, strip_urls, strip_mentions, tokens,
        stopwords_removed, noun_lemmas, stemmed_text, preview_text, porter_stems, clean_turns, bag_of_words, doc_frequency,
        ngram_counts, vocabulary, tfidf, tfidf_transform_holdout, lexical_features, lexical_by_class, pos_shares,
        tag_lexicon, sentiment_scores, sentiment_turns, readability_scores, syllables, mean_pooled_vectors,
        word2vec_docs, als_doc_embeddings, subword_embeddings, lda_topics, topic_terms, feature_layout,
        combined_scalar_features, fitted_features, chi2_scores, anova_f_scores, mutual_info_scores,
        top_chi2_features, correlated_pairs, normality_k2, class_densities, coef_cull, elasticnet_select, l1_select,
        holdout_mse, standardise, balanced_weights, knn_minority, borderline_danger, adasyn_quota, tomek_links,
        smote_points, resampled_sizes, pca_project, pca_component_search, resampling_contest, logreg_multilabel,
        boosted_tree, leafwise_tree, split_gains, halving_search, stacking, forest_importances, halving_schedule, candidate_survivors, soft_vote, weighted_vote,
        eval_metrics, confusion, confusion_normalised, class_report, macro_scores, pr_curve, roc_curve,
        best_threshold, best_overall, errors_at_threshold, threshold_sweep, sweep_optima, best_model, metrics_long,
        top_importances, sample_predictions, performance_at_threshold, stream_scoring, topic_invariants, stream_equals_batch,
        pca_invariants, word_vector_invariants, saved_pipeline_scores, registry_roundtrip,
    )
}
QUERIES["clean_text"] = cleaned
QUERIES["undersample_1_1"] = partial(_undersample, 1.0)
QUERIES["undersample_2_1"] = partial(_undersample, 0.5)
QUERIES |= {
    name: partial(_fit_and_score, trainer, name)
    for name, trainer in {
        "linear_svm_platt": models.linear_svm,
        "rff_svm": models.kernel_svm,
        "random_forest": partial(models.random_forest, class_weight="balanced"),
        "gbt": models.gradient_boosting,
        "xgb_style": models.xgb_style,
        "lgbm_style": models.lgbm_style,
        "extra_trees": models.extra_trees,
        "adaboost": models.adaboost,
    }.items()
}

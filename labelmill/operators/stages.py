"""Text models as stages of a pipeline: fitted, saved, loaded and applied like any other, and knowing what they are."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from labelmill.operators.models import CLASSES, NaiveBayes, argmax, score_in_place, train_naive_bayes
from labelmill.operators.vocabulary import build_vocabulary
from labelmill.session import materialise


class _TextParams(Params):
    tokens_col = Param(Params._dummy(), "tokens_col", "column with the tokens", TypeConverters.toString)
    label_col = Param(Params._dummy(), "label_col", "column with the class", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "multinomial or bernoulli", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "count added to each cell", TypeConverters.toFloat)
    vocab_size = Param(Params._dummy(), "vocab_size", "most entries of the vocabulary", TypeConverters.toInt)
    min_frequency = Param(Params._dummy(), "min_frequency", "least count of a token", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "the classes", TypeConverters.toListInt)

    def __init__(self):
        super().__init__()
        self._setDefault(tokens_col="tokens", label_col="labels", kind="bernoulli", alpha=1.0, vocab_size=10_000, min_frequency=3, classes=list(CLASSES))

    def _get(self, name: str):
        return self.getOrDefault(getattr(self, name))


class TextBayes(Estimator, _TextParams, DefaultParamsReadable, DefaultParamsWritable):
    """Vocabulary and naive Bayes weights from tokens and classes; fitting writes the weights once."""

    @keyword_only
    def __init__(self, *, tokens_col="tokens", label_col="labels", kind="bernoulli", alpha=1.0, vocab_size=10_000, min_frequency=3, classes=CLASSES):
        super().__init__()
        self._set(**{name: value for name, value in self._input_kwargs.items() if name != "classes"})
        self._set(classes=list(self._input_kwargs.get("classes", CLASSES)))

    def _fit(self, dataset: DataFrame) -> TextBayesModel:
        tokens, size, classes = dataset[self._get("tokens_col")], self._get("vocab_size"), tuple(self._get("classes"))
        vocabulary = materialise(build_vocabulary(dataset, tokens, size, self._get("min_frequency")), "vocabulary")
        found = train_naive_bayes(dataset, tokens, vocabulary, self._get("kind"), self._get("label_col"), self._get("alpha"), size, classes)
        fitted = NaiveBayes(found.kind, size, materialise(found.weights, "weights"), materialise(found.bias, "bias"), classes)
        return self._copyValues(TextBayesModel(fitted))


class TextBayesModel(Model, _TextParams, MLReadable, MLWritable):
    """Adds the scores of all classes, ``pred`` and, for two classes, ``probability``; every row stays where it is."""

    def __init__(self, fitted: NaiveBayes):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return argmax(score_in_place(dataset, self.fitted, dataset[self._get("tokens_col")]), self.fitted.classes)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: TextBayesModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.fitted.save(f"{path}/model")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TextBayesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(NaiveBayes.load(self.sparkSession, f"{path}/model"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model

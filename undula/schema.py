"""Column sets, dimensions and default parameters."""

from __future__ import annotations

# Names and parameters that results depend on.
FS = 20.0
WINDOW_SEC = 180.0
MARKERS = {"contraction": ("BC", "EC"), "dummy": ("BD", "ED")}
FEATURES = ["PEAK_RATE", "PEAK_AMP_MEAN", "PEAK_AMP_CV", "IPI_MEAN", "IPI_CV", "PW_MEAN", "BURST_RATE", "PEAKS_PER_BURST_MEAN", "DASDV", "LOG", "MTKE", "SE", "perm_entropy", "sampen"]
FAMILIES = {
    "Burst and peak features": FEATURES[:8],
    "Temporal energy features": FEATURES[8:11],
    "Entropy features": FEATURES[11:],
}
META = ["mode", "feature_source", "record", "label", "segment_id", "start_sample", "end_sample", "start_sec", "end_sec", "imf", "name", "start", "end", "mother_id", "group"]
MODELS = [("QDA", "QDA"), ("Logistic Regression", "LR"), ("SVM", "SVM"), ("Decision Tree", "DT"), ("Random Forest", "RF"), ("Gradient Boosting", "GB"), ("Naive Bayes", "NB"), ("MLP", "MLP"), ("CatBoost", "CB")]
DEMOGRAPHICS = ["RecType", "Gestation", "Rectime", "Age", "Parity", "Abortions", "Weight", "Placental_position", "Smoker"]
METRICS = ["accuracy", "precision", "recall", "specificity", "sensitivity", "f1", "balanced_accuracy", "mcc", "roc_auc", "average_precision"]
THRESHOLD_K, MIN_DISTANCE_SEC, REL_HEIGHT = 2.8, 0.30, 0.5
BURST_SEC = {"annotated_interval": 1.8, "fixed_3min": 2.0}
SHANNON_BINS, SAMPEN_M, SAMPEN_R, SAMPEN_TAU, PERM_M, PERM_TAU = 50, 2, 0.10, 1, 3, 1
FOLDS, REPEATS, SEED = 5, 30, 42
EPS = 1e-12

# Schemas for readers, as DDL.
RECORDINGS = "record string, label int, fs double, comments map<string,string>"
SAMPLES = "record string, channel string, n bigint, x double"
ANNOTATIONS = "record string, sample bigint, seq bigint, note string"
SEGMENTS = "mode string, record string, segment_id int, start_sample bigint, end_sample bigint, start_sec double, end_sec double"

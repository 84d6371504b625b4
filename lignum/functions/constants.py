"""Fixed values that must equal the reference's for right results."""

# --- fixed values -----------------------------------------------------------
SEP = "<sep>"            # joins the labels of a fused single-child chain
EMPTY = "<empty>"        # label of filler nodes / tokens without a unary label
BAD_ROOT = "bad_root"    # label given to a filler node that ends up as root
LANG_SUFFIX = "--"       # global vocabulary key is label + "--" + lang
PAD = -1                 # padding id of the sequence tensors (not stored here)
MAX_LENGTH = 512         # max sub-tokens per sample, including 2 specials
SPECIAL_TOKENS = 2
SAMPLE_CAP = 20000       # samples kept per language after filtering
DATASET_SEED = 123
TRAIN_SEED = 42
BATCH_SIZE = 32          # samples of a training step
TEST_FRACTION = 0.20     # first split
VALID_FRACTION = 0.1 / 0.8  # second split, of the remaining part
LANGUAGES = ("python", "java", "ruby", "javascript", "go", "c", "csharp", "php")
MODEL_NAMES = {
    "codebert": "CodeBERT",
    "codebert-baseline": "CodeBERTrand",
    "codeberta": "CodeBERTa",
    "codet5": "CodeT5",
    "graphcodebert": "GraphCodeBERT",
    "roberta": "RoBERTa",
    "distilbert": "DistilBERT",
    "bert": "BERT",
    "distilroberta": "DistilRoBERTa",
}
# sub-token mapping strategy per model type: 'bpe' drops lone space pieces
MODEL_TYPE_MAPPING = {
    "roberta": "bpe", "t5": "bpe", "bert": "wordpiece", "distilbert": "wordpiece",
    "gpt": "bpe", "gpt2": "bpe", "gpt-neo": "bpe", "gpt-j": "bpe",
}
BPE_SPACE_PIECE = "Ġ"  # the lone space piece of byte-level BPE
# label families, first match wins (contains ..., then equals member_expression)
LABEL_FAMILIES_CONTAINS = ("argument", "call", "return", "method_invocation", "block", "binary")
LABEL_FAMILY_EQUALS = "member_expression"
LABEL_FAMILY_OTHER = "unplotted"
ORTHO_PENALTY = 5.0
PROBE_INIT_RANGE = 0.05
RANK_LOSS_EPS = 1e-9
TOP_LABELS = 100
KNN_K = 10
ANALOGY_K = 3
CLUSTER_HEAD = 10
# --- end of fixed values ----------------------------------------------------

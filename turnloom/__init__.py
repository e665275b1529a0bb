"""Chat fine-tuning data and batch inference as Spark jobs."""

from turnloom.functions.merging import MergeCoder, load_merge_coder
from turnloom.functions.model_template import ModelTemplate, TemplateError, model_template
from turnloom.functions.templates import ChatTemplate, chatml, get_template, zephyr
from turnloom.operators.best_fit import fill_rate, pack_best_fit
from turnloom.operators.conversations import collect_messages, collect_pairs
from turnloom.operators.first import first_n
from turnloom.operators.holdout import holdout
from turnloom.operators.inference import (
    batch_infer, build_prompts, generate, padding_statistics, parse_ids, parse_text,
)
from turnloom.operators.layout import choose_layout, to_content
from turnloom.operators.lengths import (
    least_length, length_coverage, length_histogram, length_percentiles, merge_histograms,
)
from turnloom.operators.packing import pack_wrapped
from turnloom.operators.position import with_position
from turnloom.operators.tokenise import length_statistics, tokenise, truncate_tokens
from turnloom.plans.sft import prepare_sft
from turnloom.sources.model_settings import load_model_template
from turnloom.sources.results import write_results
from turnloom.sources.saved import write_saved_split
from turnloom.sources.splits import load_eval, load_saved_split, load_split, load_splits, parse_splits

__all__ = [
    "ChatTemplate", "MergeCoder", "ModelTemplate", "TemplateError", "batch_infer", "build_prompts", "chatml", "choose_layout", "collect_messages",
    "collect_pairs", "fill_rate", "first_n", "generate", "get_template", "holdout", "least_length", "length_coverage", "length_histogram", "length_percentiles", "length_statistics",
    "load_eval", "load_merge_coder", "load_model_template", "load_saved_split", "load_split", "load_splits", "merge_histograms", "model_template", "pack_best_fit", "pack_wrapped", "padding_statistics", "parse_ids",
    "parse_splits", "parse_text", "prepare_sft", "to_content", "tokenise", "truncate_tokens",
    "with_position", "write_results", "write_saved_split", "zephyr",
]

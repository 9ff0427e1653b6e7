"""The public operators in one namespace: ``from tokenmill import api as tm``."""

from tokenmill.functions.arrays import attention_mask, cutoff, labels_from_ids, pad_right  # noqa: F401
from tokenmill.functions.text import (  # noqa: F401
    hashed_token_ids, human_size, prompt_key, report_line, split_words, thousands,
)
from tokenmill.functions.training import (  # noqa: F401
    effective_batch, flops_per_token, global_batch, mfu, wsd_lr,
)
from tokenmill.operators.blocks import (  # noqa: F401
    as_training_view, block_keys, build_blocks, chunk, padding_report, tokenize, with_labels,
)
from tokenmill.operators.chat import (  # noqa: F401
    cap_samples, cutoff_tokens, interleave, pack, render_chat, select_sets, train_val_split,
)
from tokenmill.operators.classify import (  # noqa: F401
    classify, distinct_sources, filter_score, filter_source, merge_sources, score_bucket,
    source_distribution,
)
from tokenmill.operators.telemetry import (  # noqa: F401
    device_peaks, epoch_summary, gpu_peak, log_every, lr_by_step, lr_schedule, macro_average, resumed_epoch_summary,
    step_log, step_loss, step_rates, with_global_step,
)
from tokenmill.operators.vocab import (  # noqa: F401
    build_vocab, tokenize_with, tokenize_with_vocab, tokenizer_file_hook,
)
from tokenmill.plans.index import dense_index, dense_index_by_hash  # noqa: F401
from tokenmill.plans.permutation import epoch_places, permute, permuted_plan, resume_places  # noqa: F401
from tokenmill.plans.sampling import (  # noqa: F401
    batch, batch_sizes, checkpoint_steps, opt_steps, resume_from, run_steps, shard, shuffle_order, token_account,
    training_plan,
)
from tokenmill.sources.blocksets import read_block_sets, sample_at, write_blocks, write_indexed  # noqa: F401
from tokenmill.sources.classified import (  # noqa: F401
    count_rows, leaf_rows, read_bucket, read_classified, write_classified, write_counted,
)
from tokenmill.sources.corpus import read_corpus  # noqa: F401
from tokenmill.sources.files import file_sizes, size_report, text_bytes_report  # noqa: F401
from tokenmill.streaming.streams import stream_blocks, stream_step_loss  # noqa: F401

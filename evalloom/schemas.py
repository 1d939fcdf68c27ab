"""Declared schemas, as DDL. Reading with a schema turns absent fields into nulls."""

MANIFEST = (
    "sample_id string, task_name string, image_path string, prompt string,"
    " ground_truth string, parser string, scorer string, params string,"
    " prompt_variant int, source string"
)

RESULTS = (
    "sample_id string, task_name string, image_path string, prompt string,"
    " ground_truth string, parser string, scorer string, params string,"
    " prompt_variant int, source string, raw_response string, model string,"
    " reasoning_mode boolean, latency_s double, input_tokens bigint, output_tokens bigint,"
    " thinking_text string, parsed_answer string, correct boolean, score double,"
    " error bigint, abs_error bigint, row_correct boolean, col_correct boolean,"
    " precision double, recall double, error_message string, strategy string,"
    " strategy_selected string, strategy_n int, strategy_votes map<string,bigint>,"
    " strategy_all_answers array<string>, strategy_final_changed boolean,"
    " strategy_verify_confirmed boolean, strategy_passes int, strategy_rounds int,"
    " strategy_converged boolean, strategy_steps int, strategy_findings string,"
    " strategy_sub_questions int"
)

# One row per model call made for a sample; (sample_id, strategy, model, pass_kind,
# attempt_idx) names it.
ATTEMPTS = (
    "sample_id string, task_name string, parser string, strategy string, model string,"
    " pass_kind string, attempt_idx int, prompt string, raw_response string,"
    " latency_s double, input_tokens bigint, output_tokens bigint"
)

EPISODES = (
    "response string, chain_of_thought string, answer string, ground_truth string,"
    " metadata struct<rows:int,cols:int,strategy:string,confidence:double,logprob:double>,"
    " reward double"
)

SFT = (
    "seed bigint, strategy string, is_skip boolean, image_path string, prompt string,"
    " chain_of_thought string, answer string, ground_truth string, metadata string"
)

# What a model run delivers before anything is scored.
RESPONSES = (
    "sample_id string, task_name string, prompt string, ground_truth string, parser string,"
    " scorer string, params string, raw_response string, model string,"
    " reasoning_mode boolean, latency_s double, input_tokens bigint, output_tokens bigint"
)

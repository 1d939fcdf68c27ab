"""Fixed lookup values: task taxonomy, strategy routes, prompt texts and their tables.

Each table here has a fixed, small number of rows, so joining with it by broadcast
does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: task, perception demand, reasoning demand, category ----------
TAXONOMY = [
    ("rotated_text", "high", "none", "text_reading"),
    ("text_degradation", "high", "none", "text_reading"),
    ("dense_text", "high", "low", "text_reading"),
    ("circled_text", "medium", "none", "annotation_detection"),
    ("strikethrough", "medium", "none", "annotation_detection"),
    ("highlighted_text", "medium", "none", "annotation_detection"),
    ("form_checkboxes", "medium", "none", "ui_state_reading"),
    ("radio_button", "medium", "none", "ui_state_reading"),
    ("touching_circles", "high", "low", "spatial_discrimination"),
    ("table_cell_read", "medium", "low", "table_lookup"),
    ("form_field", "medium", "low", "table_lookup"),
    ("realistic_table", "medium", "low", "table_lookup"),
    ("merged_cell_read", "medium", "medium", "table_lookup"),
    ("arrow_annotation", "medium", "low", "annotation_detection"),
    ("color_coded_cells", "medium", "low", "color_discrimination"),
    ("bar_chart_value", "high", "low", "scale_reading"),
    ("scatter_plot", "high", "low", "scale_reading"),
    ("heatmap", "high", "low", "scale_reading"),
    ("grouped_bar", "high", "medium", "scale_reading"),
    ("stacked_bar", "high", "medium", "scale_reading"),
    ("line_chart_point", "high", "low", "scale_reading"),
    ("progress_bar", "medium", "low", "scale_reading"),
    ("pie_chart", "high", "low", "scale_reading"),
    ("legend_association", "medium", "medium", "chart_comprehension"),
    ("line_style", "high", "none", "style_discrimination"),
    ("counting_grid", "high", "medium", "counting"),
    ("nested_squares", "high", "low", "counting"),
    ("line_chart_crossing", "high", "medium", "counting"),
    ("decision_flowchart", "medium", "high", "graph_traversal"),
    ("arrow_following", "medium", "medium", "graph_traversal"),
    ("colored_paths", "high", "medium", "path_following"),
    ("edge_crossing", "high", "medium", "graph_analysis"),
    ("hierarchy_depth", "medium", "medium", "graph_analysis"),
    ("venn_diagram", "medium", "high", "set_reasoning"),
]

# Task families used for the per-family record-level accuracies.
FAMILIES = {
    "Tables": ["counting_grid", "table_cell_read", "realistic_table", "merged_cell_read"],
    "Charts": [
        "line_chart_crossing", "bar_chart_value", "line_chart_point", "legend_association",
        "pie_chart", "stacked_bar",
    ],
    "Diagrams": ["arrow_following", "decision_flowchart", "edge_crossing", "hierarchy_depth"],
    "Forms": ["form_checkboxes", "radio_button", "form_field", "progress_bar"],
    "Annotations": ["circled_text", "arrow_annotation", "strikethrough"],
    "Text/OCR": ["text_degradation", "rotated_text", "dense_text"],
    "Geometry": [
        "line_intersection", "touching_circles", "nested_squares", "colored_paths",
        "line_intersection_text",
    ],
}

DEMAND_LEVELS = ["none", "low", "medium", "high"]

BENCHMARK_TASKS = [
    "pie_chart", "colored_paths", "nested_squares", "hierarchy_depth", "realistic_table",
    "progress_bar", "scatter_plot", "text_degradation", "counting_grid",
]

STRATEGIES = [
    "baseline", "best_of_n", "crop_zoom", "verify", "decompose", "code_vision",
    "best_of_n_verify", "adaptive", "iterative_refine", "sketchpad",
]

# Clean task, same skill in a business picture, skill.
CLUTTER_PAIRS = [
    ("touching_circles", "form_checkboxes", "P5 Fine State Discrimination"),
    ("colored_paths", "arrow_following", "P2 Path Following"),
]
EXTRA_CLUTTER_PAIR = ("line_intersection", "line_chart_crossing", "P4 Intersection Detection")

# Strategy per task; any other task goes to the default route.
ROUTES = {
    "hierarchy_depth": "verify",
    "realistic_table": "verify",
    "pie_chart": "sketchpad",
    "progress_bar": "decompose",
    "nested_squares": "best_of_n",
    "colored_paths": "baseline",
    "counting_grid": "baseline",
    "scatter_plot": "baseline",
    "text_degradation": "baseline",
    "edge_crossing": "code_vision",
}
DEFAULT_ROUTE = "verify"

# How the crops of a task are combined; any other task votes.
CROP_RULES = {"counting_grid": "sum_rows_cols", "hierarchy_depth": "max"}
DEFAULT_CROP_RULE = "vote"

# (task, parameter) pairs whose accuracy curve is reported.
SENSITIVITY_PAIRS = [
    ("text_degradation", "blur_radius"), ("text_degradation", "contrast"),
    ("text_degradation", "font_size"), ("rotated_text", "rotation"),
    ("rotated_text", "font_size"), ("dense_text", "font_size"), ("dense_text", "n_lines"),
    ("strikethrough", "font_size"), ("strikethrough", "n_struck"),
    ("strikethrough", "line_thickness"), ("realistic_table", "n_rows"),
    ("realistic_table", "font_size"), ("counting_grid", "n_merged"),
    ("line_intersection", "n_points"), ("nested_squares", "depth"),
    ("colored_paths", "n_paths"), ("arrow_following", "n_boxes"),
    ("arrow_following", "n_arrows"), ("hierarchy_depth", "depth"), ("pie_chart", "n_slices"),
]

# Words in a second look that count as a confirmation (substring match).
CONFIRM_WORDS = ["correct", "yes", "confirmed", "right", "accurate"]

SIZE_BUCKETS = [("3-8", 3, 8), ("9-12", 9, 12), ("13-18", 13, 18), ("19-25", 19, 25)]
CONFIDENCE_BINS = [
    ("0.0-0.3", 0.0, 0.3), ("0.3-0.5", 0.3, 0.5), ("0.5-0.7", 0.5, 0.7),
    ("0.7-0.9", 0.7, 0.9), ("0.9-1.0", 0.9, 1.01),
]

# Seed ranges: split, lower bound, upper bound (exclusive; None = open).
SEED_SPLITS = [
    ("sft", 0, 100_000), ("rl", 100_000, 500_000), ("eval", 500_000, 510_000),
    ("verify", 999_000, None),
]
SFT_SEED_RANGES = [
    ("direct", 0, 20_000), ("intermediate_repr", 20_000, 40_000), ("tool_use", 40_000, 50_000),
]
GRID_RANGES = {
    "direct": (3, 12), "intermediate_repr": (3, 15), "tool_use": (12, 25),
    "tool_use_skip": (3, 8),
}
BACKGROUNDS = [(255, 255, 255), (240, 240, 240), (245, 245, 230), (230, 240, 250)]

# Distractor offsets, as shares of the right value.
DISTRACTOR_OFFSETS = [0.2, -0.2, 0.35, -0.35, 0.5, -0.5, 0.15, -0.15]
CHOICE_CLOSING = "Answer with only the letter."

# Sketchpad tools and the argument a bare value stands for.
SKETCH_TOOLS = [
    "detect_edges", "count_line_transitions", "detect_contours", "segment_colors",
    "measure_bar_fill", "detect_boxes", "cluster_by_y", "crop_and_enhance",
    "trace_colored_paths", "detect_points",
]
POSITIONAL_ARGUMENTS = {
    "crop_and_enhance": "region",
    "count_line_transitions": "axis",
    "detect_points": "target_color",
}

# Prompt keyword, plan category, steps; the first that matches wins.
_LINES = "count_line_transitions(axis=horizontal); count_line_transitions(axis=vertical)"
_PATHS = "segment_colors(exclude_white=true, exclude_black=true); trace_colored_paths()"
_CELLS = "detect_boxes(); crop_and_enhance(region=center)"
PLAN_RULES = [
    (r"(grid|lines|rows.*columns|columns.*rows)", "grid_counting", _LINES),
    (r"(count|how many).*(square|circle|shape|triangle|rectangle|contour)", "shape_counting",
     "detect_contours()"),
    (r"(level|depth|hierarch|layers?\b|how many.*deep|rows of boxes)", "hierarchy",
     "detect_boxes(); cluster_by_y()"),
    (r"(percentage|percent|proportion|slice.*represent|area.*region)", "proportion",
     "segment_colors()"),
    (r"(progress.*bar|bar.*fill|fraction.*filled)", "bar_fill", "measure_bar_fill()"),
    (r"(path|route|connect|from.*to|go from)", "path_tracing", _PATHS),
    (r"(table|row|column|cell|what is the.*for)", "table_lookup", _CELLS),
    (r"(y-value|x-value|scatter|point at|coordinate|data point)", "scatter", "detect_points()"),
    (r"(text|read|say|written|OCR|what does)", "text_reading", "crop_and_enhance(region=full)"),
    (r"(count|how many)", "counting", "detect_contours()"),
]
FALLBACK_PLAN = ("fallback", "detect_edges(); detect_contours()")
TASK_PLANS = {
    "counting_grid": _LINES,
    "pie_chart": "segment_colors()",
    "colored_paths": _PATHS,
    "nested_squares": "detect_contours(min_area=50)",
    "hierarchy_depth": "detect_boxes(); cluster_by_y()",
    "realistic_table": _CELLS,
    "progress_bar": "measure_bar_fill()",
    "scatter_plot": "detect_points()",
    "text_degradation": "crop_and_enhance(region=full)",
}

# Sub-questions of the tasks that have a fixed split.
QUESTION_SPLITS = {
    "pie_chart": [
        "What distinct color regions exist in the image and what are their relative areas?",
        "What is the area of the target region as a percentage of the whole?",
    ],
    "counting_grid": [
        "How many horizontal lines are in the grid?",
        "How many vertical lines are in the grid?",
    ],
    "hierarchy_depth": [
        "Where are the boxes or nodes positioned in the image?",
        "How many distinct horizontal rows do the boxes form?",
    ],
    "progress_bar": ["Where are the progress bars in the image and what fraction is filled?"],
    "colored_paths": [
        "What distinct colored paths exist in the image?",
        "What are the start and end points for each colored path?",
    ],
    "realistic_table": [
        "Where are the table cell boundaries?",
        "What is the content of the target cell?",
    ],
    "nested_squares": [
        "What rectangular contours exist in the image?",
        "How many concentric squares are there from outside to inside?",
    ],
    "scatter_plot": [
        "Where are the data points in the image?",
        "What is the y-value at the target x-coordinate?",
    ],
    "text_degradation": ["What text is visible in the image?"],
}

# Critique of a refinement round, per task.
CRITIQUES = {
    "counting_grid": (
        "Scan the image systematically: count horizontal lines by moving "
        "top-to-bottom, then count vertical lines by moving left-to-right. "
        "Include border lines. Don't guess — be methodical."
    ),
    "pie_chart": (
        "Verify that your estimated percentages sum to 100%. Use visual "
        "anchors: a quarter-circle is 25%, a half is 50%. Re-examine each "
        "slice's angle relative to these anchors."
    ),
    "progress_bar": (
        "Estimate the filled portion relative to the full bar width. "
        "Look for tick marks, labels, or percentage indicators as reference "
        "points. Express your answer as a percentage."
    ),
    "hierarchy_depth": (
        "Count the number of HORIZONTAL ROWS of boxes, not the number of "
        "connections. The root is row 1. Count each distinct row below it."
    ),
    "nested_squares": (
        "Check the center of the image carefully for tiny inner squares "
        "you may have missed. Count from the outermost square inward."
    ),
}
DEFAULT_CRITIQUE = "Re-examine the image step by step. Check your previous answer carefully."

# Follow-up prompt texts; {question}, {answer}, {history} and the like mark what is filled in.
VERIFY_PROMPT = (
    "You previously answered this question about the image:\n\n"
    "Question: {question}\nYour answer: {answer}\n\n"
    "Look at the image again very carefully. Is your answer correct? If not, provide "
    "the correct answer. Respond with ONLY the corrected answer in the same format as before."
)
VERIFY_LEVELS_PROMPT = (
    "You previously answered this question about the image:\n\n"
    "Question: {question}\nYour answer: {answer}\n\n"
    "IMPORTANT: Count the number of HORIZONTAL ROWS of boxes, NOT the number of "
    "connections/edges between rows. For example, if the root is in row 1 and the leaves "
    "are in row 3, the answer is 3 (not 4). Look at the image again. Is {answer} correct? "
    "If not, provide the correct answer in curly brackets."
)
CONSENSUS_PROMPT = (
    "Look at this image very carefully.\n\nQuestion: {question}\n"
    "A previous analysis concluded the answer is: {answer}\n\n"
    "Examine the image closely. Is this answer correct? If not, what is the correct answer? "
    "Respond with ONLY the answer in the same format."
)
DECOMPOSE_PROMPT = (
    "Based on your detailed analysis of the image:\n\n{history}"
    "\n\nNow answer the original question: {question}"
)
REFINE_PROMPT = (
    "You have answered this question about the image {rounds} time(s):\n\n"
    "Question: {question}\nYour prior answers:\n{history}\n\nCritique: {critique}\n\n"
    "Look at the image again. Provide your revised answer in the same format as the "
    "original question asks."
)
SKETCH_TOOL_MENU = (
    '- crop_and_enhance(region): Zoom into a region ("center", "top-left", "top-right", '
    '"bottom-left", "bottom-right")\n'
    "- detect_contours(): Find and highlight shape boundaries\n"
    "- segment_colors(): Isolate distinct color regions with area percentages\n"
    '- count_line_transitions(axis): Count lines along "horizontal" or "vertical"\n'
    "- measure_bar_fill(): Measure filled vs total width of bars\n"
    "- detect_boxes(): Find rectangular boxes and their positions\n"
    "- cluster_by_y(): Group boxes into horizontal levels\n"
    "- detect_edges(): Highlight edges in the image\n"
    "- detect_points(): Find colored data points\n"
    "- trace_colored_paths(): Trace colored line paths"
)
SKETCH_PROMPT = (
    "You are analyzing an image with a visual sketchpad. The image has been "
    "annotated with analysis results from vision tools.\n\n"
    "The question was decomposed into sub-questions. Analysis so far (pass {round}):\n"
    "{history}\nAvailable tools (reply with TOOL(name, args) to use one):\n{menu}\n\n"
    "Synthesize the sub-question findings and reply with ANSWER followed by "
    "your response to the original question:\n{question}"
)
# --------------------------------------------------------------------------------


def inline_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of literals, which are part of the plan."""

    names = columns.split(", ")
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.inline(listed))


def taxonomy(spark: SparkSession) -> DataFrame:
    return inline_table(spark, TAXONOMY, "task_name, perception, reasoning, category")


def families(spark: SparkSession) -> DataFrame:
    rows = [(task, family) for family, tasks in FAMILIES.items() for task in tasks]
    return inline_table(spark, rows, "task_name, category")


def clutter_pairs(spark: SparkSession, extended: bool = False) -> DataFrame:
    rows = ([EXTRA_CLUTTER_PAIR] if extended else []) + CLUTTER_PAIRS
    return inline_table(spark, rows, "clean_task, business_task, primitive")


def strategy_ranks(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    return inline_table(spark, list(enumerate(names or STRATEGIES)), "rank, strategy")

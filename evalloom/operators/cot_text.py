"""Default worked-answer templates for grid sizes.

The wording is this library's own; what the rewards read is fixed: line counts,
cells = lines - 1, and a closing ``rows=N columns=M``. Pass other texts to
``generate.fill_worked_answer`` to use a different set.
"""

QUESTION = "How many rows and columns does this grid have? Reply as: rows=N columns=M"

CORRECTION = "Hold on: {h_lines} is the line count. {h_lines} - 1 = {rows} rows, one fewer than the lines."

_END = "\n\nrows={rows} columns={cols}"

_SCAN_CODE = (
    "```python\n"
    "import numpy as np\n"
    "from PIL import Image\n"
    "page = np.asarray(Image.open(image_path).convert('L')) < 128\n"
    "def runs(axis):\n"
    "    on = page.mean(axis=axis) > {share}\n"
    "    return int(on[0]) + int((on[1:] & ~on[:-1]).sum())\n"
    "across, down = runs(1), runs(0)\n"
    "print(f'{{across - 1}} rows, {{down - 1}} columns')\n"
    "```\n\n"
)


def _scan(share: str) -> str:
    return _SCAN_CODE.replace("{share}", share)


TEMPLATES = {
    "direct": [
        "Lines first, cells second.\nHorizontal edges: 2 borders and {h_interior} dividers, "
        "so {h_lines} horizontal lines → {rows} rows.\nUpright edges: 2 borders and "
        "{v_interior} dividers, so {v_lines} vertical lines → {cols} columns." + _END,
        "Counting horizontal strokes from the top gives {h_lines}; {h_lines} - 1 = {rows} rows.\n"
        "Counting upright strokes from the left gives {v_lines}; {v_lines} - 1 = {cols} columns." + _END,
        "A row lies between two horizontal strokes. There are {h_lines} of them: "
        "{h_lines} lines means {rows} rows.\nA column lies between two upright strokes. "
        "There are {v_lines} of them: {v_lines} lines means {cols} columns." + _END,
        "Between the outer borders I find {h_interior} horizontal dividers, so {h_lines} lines "
        "make {rows} rows.\nAcross, {v_interior} dividers, so {v_lines} lines make {cols} columns." + _END,
        "Fence posts and gaps: {h_lines} horizontal posts leave {h_lines} - 1 = {rows} rows; "
        "{v_lines} upright posts leave {v_lines} - 1 = {cols} columns." + _END,
    ],
    "intermediate_repr": [
        "Tally:\n- horizontal: {h_lines} lines (2 borders, {h_interior} inside)\n"
        "- vertical: {v_lines} lines (2 borders, {v_interior} inside)\n"
        "Cells:\n- {h_lines} lines → {rows} rows\n- {v_lines} lines → {cols} columns" + _END,
        "A drawing of what I see:\n{ascii_sketch}\nFrom it, {h_lines} horizontal lines → {rows} rows "
        "and {v_lines} vertical lines → {cols} columns." + _END,
        "direction | lines | cells\nhorizontal | {h_lines} | {rows}\nvertical | {v_lines} | {cols}\n"
        "Check: {h_lines} - 1 = {rows} rows, {v_lines} - 1 = {cols} columns." + _END,
        "First the strokes: {h_lines} horizontal, {v_lines} vertical.\nThen the gaps: "
        "{h_lines} - 1 = {rows} rows and {v_lines} - 1 = {cols} columns." + _END,
        "Top border, {h_interior} horizontal dividers, bottom border: {h_lines} lines, so {rows} rows.\n"
        "Left border, {v_interior} dividers, right border: {v_lines} lines, so {cols} columns." + _END,
    ],
    "tool_use": [
        "Too dense to count by eye, so I measure it.\n\n" + _scan("0.5")
        + "```output\n{rows} rows, {cols} columns\n```\n\n"
        "The scan saw {h_lines} lines → {rows} rows and {v_lines} lines → {cols} columns." + _END,
        "A projection of the dark pixels will separate the strokes.\n\n" + _scan("0.3")
        + "```output\n{rows} rows, {cols} columns\n```\n\n"
        "That is {h_lines} - 1 = {rows} rows and {v_lines} - 1 = {cols} columns." + _END,
        "I would lose count here; code is safer.\n\n" + _scan("0.4")
        + "```output\n{rows} rows, {cols} columns\n```\n\n"
        "So {h_lines} lines give {rows} rows, and {v_lines} lines give {cols} columns." + _END,
    ],
    "tool_use_skip": [
        "Few cells, no code needed.\n{h_lines} horizontal lines → {rows} rows, "
        "{v_lines} vertical lines → {cols} columns." + _END,
        "Small enough to read directly: {h_lines} - 1 = {rows} rows, {v_lines} - 1 = {cols} columns." + _END,
        "I can see every stroke. {h_lines} lines make {rows} rows and {v_lines} lines make {cols} columns." + _END,
    ],
}

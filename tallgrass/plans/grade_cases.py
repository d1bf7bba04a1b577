"""Hand-made cases of the grader: what a response boxes, the gold answers, and whether they are equal."""

#: (boxes or a whole response, gold answers, equal)
CASES = (
    (("\\frac{1}{2}",), ("0.5",), True), (("\\frac12",), ("1/2",), True), (("\\dfrac{3}{4}",), ("0.75",), True), (("3/4",), ("\\frac{3}{4}",), True), (("0.3333",), ("\\frac{1}{3}",), False),
    (("[0, 14]",), ("[0,14]",), True), (("(1,2)\\cup(3,4]",), ("(3,4]\\cup(1,2)",), True), (("(1,2)",), ("[1,2]",), False), (("(-\\infty, 3)",), ("(-\\infty,3)",), True), (("(1, 2]",), ("(1, 2)",), False),
    (("x^2-1",), ("(x-1)(x+1)",), True), (("x^2+1",), ("(x-1)(x+1)",), False), (("2x+4y=6",), ("x+2y=3",), True), (("2x+4y=7",), ("x+2y=3",), False), (("y=2x+1",), ("2x+1",), True),
    (("1.5\\times 10^{3}",), ("1500",), True), (("3\\sqrt{2}",), ("\\sqrt{18}",), True), (("\\log_2 8",), ("3",), True), (("2\\pi",), ("6.283185307179586",), True), (("\\sqrt2",), ("\\sqrt{2}",), True),
    (("x=5",), ("5",), True), (("a=b=5",), ("5",), True), (("2+3=5",), ("5",), True), (("\\{3, 1, 2\\}",), ("\\{1,2,3\\}",), True), (("(1, 2)",), ("(2, 1)",), True), (("30^\\circ",), ("30",), True),
    (("30^{\\circ}",), ("30",), True), (("100.000",), ("100",), True), (("7",), ("8",), False), (("-10",), ("10",), True), ((".5",), ("5",), True), (("1",), ("yes",), True), (("0",), ("false",), True),
    (("t",), ("True",), True), (("Mon",), ("Monday",), True), (("Tues",), ("tuesday",), True), (("a", "b"), ("b", "a"), False), (("3",), ("3", "4"), False), (("3, 4",), ("3", "4"), True), (("3", "4"), ("3", "4"), True),
    (("14.026", "19.373", "A,B"), ("14.026", "19.373", "AB"), False), (("0",), ("0",), True), (("\\sin^{2}x+\\cos^{2}x",), ("2-1+0x+0",), True), (("\\sin^{-1}x",), ("\\arcsin x",), True), (("x \\pm 2",), ("(x-2,x+2)",), True),
    (("\\text{no solution}",), ("no solution",), True), (("DNE",), ("dne",), True), (("5\\text{cm}",), ("5",), False), (("half",), ("1/2",), True), (("three",), ("3",), True), (("\\left(1, 2\\right)",), ("(1,2)",), True),
    (("1.6448536270",), ("1.645",), False), (("AB",), ("BA",), True), (("AC",), ("AB",), False), (("\\mathbf{7}",), ("7",), True), (("e^{2x}",), ("e^{x}e^{x}",), True), (("5!",), ("120",), False), (("|-3|",), ("3",), False),
    (("2x",), ("3x",), False), (("\\frac{x}{2}",), ("0.5x",), True), (("\\binom{4}{2}",), ("6",), True), (("1,000",), ("1000",), False), (("\\begin{pmatrix}1&2\\end{pmatrix}",), ("\\begin{bmatrix}1&2\\end{bmatrix}",), True),
    ("The answer is 42.", ("42",), True), ("so it is $x+1$", ("1+x",), True), ("nothing here", ("1",), False), ("", ("1",), False), ("12 is the answer", ("12",), True), ("we get 7 and then 9", ("9",), True),
    ("first \\boxed{4}, no: Final Answer: \\boxed{5}", ("5",), True), ("<think>\\boxed{4}</think> done \\boxed{6}", ("6",), True), ("Therefore \\boxed{3}", ("3",), True), ("\\boxed{5}. Therefore we stop at 6", ("6",), True),
    ("#### 17", ("17",), True), ("\\boxed{}", ("1",), False), ("\\boxed{1", ("1",), False), ("\\fbox{2} and \\boxed{3}", ("3",), True), ("answer: $8$", ("8",), True),
)


def response(said: tuple[str, ...] | str) -> str:
    """The response of a case."""
    return said if isinstance(said, str) else "<think>\nx\n</think>\n\nFinal Answer: " + ", ".join(f"\\boxed{{{x}}}" for x in said)

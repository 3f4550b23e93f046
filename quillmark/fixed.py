"""Fixed values. Papers, prompts and sheets are exchanged with people and other
programs, so these texts, patterns and limits have to be exactly these."""

# Marks written around the fields of a paper.
FRONT_FIRST_NAME, END_FIRST_NAME = "front_F1R5T_N4M3", "end_F1R5T_N4M3"
FRONT_SURNAME, END_SURNAME = "front_5URN4M3", "end_5URN4M3"
FRONT_STUDENT_ID, END_STUDENT_ID = "front_5TUD3NT_1D", "end_5TUD3NT_1D"
FRONT_QUESTION, END_QUESTION = "front_QU35T10N", "end_QU35T10N"
FRONT_ANSWER, END_ANSWER = "front_4N5W3R", "end_4N5W3R"
FRONT_ALTERNATIVE, END_ALTERNATIVE = "front_41T", "end_41T"
FRONT_POINTS, END_POINTS = "front_P01NT5", "end_P01NT5"

# Visible labels. {k} is the number of the question.
LABEL_FIRST_NAME, LABEL_SURNAME, LABEL_STUDENT_ID = "First name", "Surname", "Student ID"
TEACHER_TITLE_SUFFIX = " Sample Solution"
TEACHER_QUESTION_LABEL, STUDENT_QUESTION_LABEL = " Question {k}:", " Question {k}: "
TEACHER_ANSWER_LABEL, STUDENT_ANSWER_LABEL = " Answer {k}:", " Answer {k}: "
ALTERNATIVE_LABEL = "Alternative Solution {k}:"
POINTS_LABEL = " Points for Question {k}: "

# Solution types, in the order that wins a tie.
SAMPLE, ALTERNATIVE = "Sample Solution", "Alternative Solution"

# Scheme names of the sheets and the wording each one has in a prompt.
SCHEMES = {
    "full_points": "full points like 0, 1 or 2",
    "half_points": "full points or half points like 0, 0.5 or 1",
    "quarter_points": "full points or quarter points like 0, 0.25 or 0.5",
}
DEFAULT_SCHEME = "quarter_points"

# Rounding methods and the number of steps in one point.
ROUNDING = {"Full Points": 1, "Half Points": 2, "Quarter Points": 4}

# Prompts. Names in braces are columns.
GRADING_PROMPT = (
    "You are a teacher grading exam questions, please provide a score from 0 to {points} for the "
    "following student answer. Use the following grading scheme: {scheme}. Question: {question}, "
    "Student Solution: {student_solution}, Sample Solution: {solution}, Cosine Similarity between "
    "sample solution and student solution: {cosine_similarity}, Score:"
)
FEEDBACK_PROMPT = (
    "You are a teacher grading exam questions, please explain the number of points a student has "
    "received based on the question, sample solution, and student answer. Provide short feedback "
    "why this student has received {awarded} points out of {points} total points for the following "
    "student answer. Question: {question}, Student Solution: {student_solution}, Sample Solution: "
    "{solution}, Feedback:"
)
NOT_ANSWERED = "Question has not been answered"

# Generation settings and the token limit.
GENERATION = {"top_k": 3, "top_p": 0.5, "temperature": 0.5}
PROMPT_TOKENS = 924

# First number in a reply.
NUMBER = r"[-+]?\d*\.\d+|\d+"

# Points on the fitted curve.
CURVE_POINTS = 100

# Characters that count as white space when a field is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# The same characters as a class, negated: one of these makes a text not blank.
NOT_WHITE = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"

# Pre-tokens of the published byte-pair tokenizer the prompt budget is counted in.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\t-\r\x{85}\p{Z}\p{L}\p{N}]+"
    r"|[\t-\r\x{85}\p{Z}]+(?![^\t-\r\x{85}\p{Z}])|[\t-\r\x{85}\p{Z}]+"
)

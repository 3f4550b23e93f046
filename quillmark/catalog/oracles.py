"""The same results in SQL, written apart from the library.

Each query starts from a few shared views of the driver tables; ``_sql`` puts the
ones it needs in front.
"""

from quillmark import fixed

SEED = 7
_N = "(SELECT count(*) FROM benchmark)"
_WS = "'" + fixed.WHITE_SPACE + "'"


def _six(value: str) -> str:
    """Six decimals, and no negative zero."""
    return f"(round({value}, 6) + 0.0)"


def _answered(column: str = "student_solution") -> str:
    return f"(trim({column}, {_WS}) <> '')"


def _exam(item: str) -> str:
    return f"'E' || lpad(CAST({item} // 20 + 1 AS VARCHAR), 4, '0')"


def _q(item: str) -> str:
    return f"CAST({item} % 20 + 1 AS INTEGER)"


def _points_text(points: str) -> str:
    return (
        f"CASE WHEN {points} = floor({points}) THEN CAST(CAST({points} AS BIGINT) AS VARCHAR) "
        f"ELSE CAST({points} AS VARCHAR) END"
    )


_CTE = {
    "items": f"""
        SELECT b.item_id, {_exam('b.item_id')} AS exam_id, {_q('b.item_id')} AS q_no,
               'Item ' || b.item_id || ': ' || b.text AS question, b.text AS sample_solution,
               coalesce(o.text, '') AS alternative_solution,
               CAST(b.item_id % 5 AS DOUBLE) AS points
        FROM benchmark b
        LEFT JOIN benchmark o ON b.item_id % 2 = 0 AND o.item_id = (b.item_id + 1) % {_N}""",
    "answers": f"""
        SELECT d.doc_id, {_exam(f'(d.doc_id % {_N})')} AS exam_id,
               lpad(CAST(d.doc_id // {_N} AS VARCHAR), 6, '0') AS student_id,
               c.c_name AS first_name, c.c_mktsegment AS surname,
               {_q(f'(d.doc_id % {_N})')} AS q_no,
               CASE WHEN d.doc_id % 17 = 0 THEN '' ELSE d.text END AS student_solution
        FROM documents d LEFT JOIN customer c ON c.c_custkey = d.doc_id // {_N}""",
    "roster": """
        SELECT exam_id, student_id, min(first_name) AS first_name, min(surname) AS surname
        FROM answers GROUP BY exam_id, student_id""",
    "evaluation": """
        SELECT r.exam_id, r.student_id, r.first_name, r.surname, i.q_no,
               coalesce(a.student_solution, '') AS student_solution, i.question, i.points,
               i.sample_solution, i.alternative_solution
        FROM roster r JOIN items i ON i.exam_id = r.exam_id
        LEFT JOIN answers a
          ON a.exam_id = r.exam_id AND a.student_id = r.student_id AND a.q_no = i.q_no""",
    "solutions": """
        SELECT exam_id, q_no, 'Sample Solution' AS solution_type, 0 AS type_rank,
               sample_solution AS solution FROM items
        UNION ALL
        SELECT exam_id, q_no, 'Alternative Solution', 1, alternative_solution FROM items
        WHERE alternative_solution <> ''""",
    "gradings": """
        SELECT a.exam_id, a.student_id, a.q_no, i.points,
               CAST(l.quality * i.points AS VARCHAR) AS grading
        FROM labels l JOIN answers a ON a.doc_id = l.doc_id
        JOIN items i ON i.exam_id = a.exam_id AND i.q_no = a.q_no""",
    # Word counts of both sides, and the cosine of every answer and solution.
    "answer_words": r"""
        SELECT exam_id, student_id, q_no, word, count(*) AS n FROM (
          SELECT exam_id, student_id, q_no,
                 unnest(regexp_extract_all(lower(student_solution), '[\p{L}\p{N}]+')) AS word
          FROM answers) GROUP BY ALL""",
    "solution_words": r"""
        SELECT exam_id, q_no, solution_type, word, count(*) AS n FROM (
          SELECT exam_id, q_no, solution_type,
                 unnest(regexp_extract_all(lower(solution), '[\p{L}\p{N}]+')) AS word
          FROM solutions) GROUP BY ALL""",
    "answer_length": """
        SELECT exam_id, student_id, q_no, sqrt(CAST(sum(n * n) AS DOUBLE)) AS length
        FROM answer_words GROUP BY ALL""",
    "solution_length": """
        SELECT exam_id, q_no, solution_type, sqrt(CAST(sum(n * n) AS DOUBLE)) AS length
        FROM solution_words GROUP BY ALL""",
    "shared_words": """
        SELECT a.exam_id, a.student_id, a.q_no, s.solution_type,
               CAST(sum(a.n * s.n) AS DOUBLE) AS top
        FROM answer_words a
        JOIN solution_words s ON s.exam_id = a.exam_id AND s.q_no = a.q_no AND s.word = a.word
        GROUP BY ALL""",
    "word_pairs": f"""
        SELECT e.exam_id, e.student_id, e.first_name, e.surname, e.q_no, e.question,
               e.student_solution, e.points, s.solution_type, s.type_rank, s.solution,
               CASE WHEN w.top IS NULL THEN 0.0 ELSE w.top / (al.length * sl.length) END
                 AS cosine_similarity
        FROM evaluation e
        JOIN solutions s ON s.exam_id = e.exam_id AND s.q_no = e.q_no
        LEFT JOIN shared_words w ON w.exam_id = e.exam_id AND w.student_id = e.student_id
          AND w.q_no = e.q_no AND w.solution_type = s.solution_type
        LEFT JOIN answer_length al ON al.exam_id = e.exam_id AND al.student_id = e.student_id
          AND al.q_no = e.q_no
        LEFT JOIN solution_length sl ON sl.exam_id = e.exam_id AND sl.q_no = e.q_no
          AND sl.solution_type = s.solution_type
        WHERE {_answered('e.student_solution')}""",
    "word_scored": f"""
        SELECT * EXCLUDE (type_rank, place),
               dense_rank() OVER (ORDER BY exam_id, student_id, q_no) - 1 AS identification
        FROM (
          SELECT *, row_number() OVER (PARTITION BY exam_id, student_id, q_no
                                       ORDER BY cosine_similarity DESC, type_rank) AS place
          FROM (
            SELECT * FROM word_pairs
            UNION ALL
            SELECT exam_id, student_id, first_name, surname, q_no, question, student_solution,
                   points, 'Sample Solution', 0, sample_solution, 0.0
            FROM evaluation WHERE NOT {_answered()}))
        WHERE place = 1""",
    # Vectors: samples, alternatives, answers.
    "vector_answers": f"""
        SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS answer_vector,
               {_exam(f'((e.vec_id - 2 * {_N}) % {_N})')} AS exam_id,
               lpad(CAST((e.vec_id - 2 * {_N}) // {_N} AS VARCHAR), 6, '0') AS student_id,
               c.c_name AS first_name, c.c_mktsegment AS surname,
               {_q(f'((e.vec_id - 2 * {_N}) % {_N})')} AS q_no,
               CASE WHEN e.vec_id % 17 = 0 THEN '' ELSE 'Answer ' || e.vec_id END
                 AS student_solution
        FROM embeddings e
        LEFT JOIN customer c ON c.c_custkey = (e.vec_id - 2 * {_N}) // {_N}
        WHERE e.vec_id >= 2 * {_N}""",
    "vector_solutions": f"""
        SELECT i.exam_id, i.q_no, 'Sample Solution' AS solution_type, 0 AS type_rank,
               i.sample_solution AS solution, CAST(e.embedding AS DOUBLE[]) AS solution_vector
        FROM items i JOIN embeddings e ON e.vec_id = i.item_id
        UNION ALL
        SELECT i.exam_id, i.q_no, 'Alternative Solution', 1, i.alternative_solution,
               CAST(e.embedding AS DOUBLE[])
        FROM items i JOIN embeddings e ON e.vec_id = i.item_id + {_N}
        WHERE i.alternative_solution <> ''""",
    "vector_pairs": f"""
        SELECT a.exam_id, a.student_id, a.first_name, a.surname, a.q_no, i.question,
               a.student_solution, i.points, s.solution_type, s.type_rank, s.solution,
               list_cosine_similarity(a.answer_vector, s.solution_vector) AS cosine_similarity
        FROM vector_answers a JOIN items i ON i.exam_id = a.exam_id AND i.q_no = a.q_no
        JOIN vector_solutions s ON s.exam_id = a.exam_id AND s.q_no = a.q_no
        WHERE {_answered('a.student_solution')}""",
    "vector_grid": """
        SELECT r.*, i.q_no, i.question, i.points, i.sample_solution
        FROM (SELECT exam_id, student_id, min(first_name) AS first_name, min(surname) AS surname
              FROM vector_answers GROUP BY exam_id, student_id) r
        JOIN items i ON i.exam_id = r.exam_id""",
    "vector_scored": """
        SELECT exam_id, student_id, first_name, surname, q_no, question, student_solution, points,
               solution_type, solution, cosine_similarity,
               dense_rank() OVER (ORDER BY exam_id, student_id, q_no) - 1 AS identification
        FROM (
          SELECT *, row_number() OVER (PARTITION BY exam_id, student_id, q_no
                                       ORDER BY cosine_similarity DESC, type_rank) AS place
          FROM (
            SELECT * FROM vector_pairs
            UNION ALL
            SELECT g.exam_id, g.student_id, g.first_name, g.surname, g.q_no, g.question, '',
                   g.points, 'Sample Solution', 0, g.sample_solution, 0.0
            FROM vector_grid g
            WHERE NOT EXISTS (SELECT 1 FROM vector_pairs p WHERE p.exam_id = g.exam_id
              AND p.student_id = g.student_id AND p.q_no = g.q_no)))
        WHERE place = 1""",
    "vector_grading": f"""
        SELECT s.identification, s.question, s.points, s.solution, s.student_solution,
               CASE WHEN a.vec_id % 3 = 0
                 THEN CAST(least(CAST(a.vec_id % 5 AS DOUBLE), s.points) AS VARCHAR)
                 ELSE '' END AS grading, s.exam_id, s.cosine_similarity
        FROM vector_scored s JOIN vector_answers a ON a.exam_id = s.exam_id
          AND a.student_id = s.student_id AND a.q_no = s.q_no
        WHERE {_answered('s.student_solution')}""",
    "train": """
        SELECT exam_id, cosine_similarity AS x, CAST(grading AS DOUBLE) / points AS y
        FROM vector_grading WHERE grading <> '' AND points <> 0""",
    "anchored": "SELECT x, y FROM train UNION ALL VALUES (0.0, 0.0), (1.0, 1.0)",
    "anchored_by_exam": """
        SELECT exam_id, x, y FROM train
        UNION ALL SELECT DISTINCT exam_id, 0.0, 0.0 FROM train
        UNION ALL SELECT DISTINCT exam_id, 1.0, 1.0 FROM train""",
    "anchored_but_one": """
        SELECT exam_id, x, y FROM train WHERE exam_id <> 'E0002'
        UNION ALL SELECT DISTINCT exam_id, 0.0, 0.0 FROM vector_scored
        UNION ALL SELECT DISTINCT exam_id, 1.0, 1.0 FROM vector_scored""",
    "model_but_one": "{FIT_BUT_ONE}",
    "model": "{FIT}",
    "model_by_exam": "{FIT_BY_EXAM}",
    "predicted": f"""
        SELECT s.*, CASE WHEN {_answered('s.student_solution')}
                 THEN m.b0 + m.b1 * s.cosine_similarity + m.b2 * s.cosine_similarity * s.cosine_similarity
                 ELSE 0.0 END AS relative_points
        FROM vector_scored s, model m""",
}


def _fit(table: str, by: str = "") -> str:
    """Normal equations of the quadratic, on centred moments."""
    keys = f"{by}, " if by else ""
    return f"""
        SELECT {keys} my - b1 * mx - b2 * mx2 AS b0, b1, b2, n, degenerate FROM (
          SELECT *, CASE WHEN degenerate THEN p / a / 2 ELSE (p * b - q * c) / (a * b - c * c) END AS b1,
                 CASE WHEN degenerate THEN p / a / 2 ELSE (q * a - p * c) / (a * b - c * c) END AS b2
          FROM (SELECT *, a * b - c * c <= 1e-12 * a * b AS degenerate FROM (
            SELECT {keys} count(*) AS n, avg(x) AS mx, avg(x * x) AS mx2, avg(y) AS my,
                   regr_sxx(x, x) AS a, regr_sxx(x * x, x * x) AS b, regr_sxy(x, x * x) AS c,
                   regr_sxy(y, x) AS p, regr_sxy(y, x * x) AS q
            FROM {table} {f'GROUP BY {by}' if by else ''})))"""


# Blank alternatives take part too.
_CTE["vector_solutions_all"] = _CTE["vector_solutions"].replace("WHERE i.alternative_solution <> ''", "")
_CTE["vector_pairs_all"] = _CTE["vector_pairs"].replace("vector_solutions", "vector_solutions_all")
_CTE["vector_scored_all"] = _CTE["vector_scored"].replace("vector_pairs", "vector_pairs_all")
_CTE["model"] = _fit("anchored")
_CTE["model_by_exam"] = _fit("anchored_by_exam", "exam_id")
_CTE["model_but_one"] = _fit("anchored_but_one", "exam_id")

_NEEDS = {
    "roster": ["answers"],
    "evaluation": ["roster", "items", "answers"],
    "solutions": ["items"],
    "gradings": ["answers", "items"],
    "answer_words": ["answers"],
    "solution_words": ["solutions"],
    "answer_length": ["answer_words"],
    "solution_length": ["solution_words"],
    "shared_words": ["answer_words", "solution_words"],
    "word_pairs": ["evaluation", "solutions", "shared_words", "answer_length", "solution_length"],
    "word_scored": ["word_pairs", "evaluation"],
    "vector_solutions": ["items"],
    "vector_pairs": ["vector_answers", "items", "vector_solutions"],
    "vector_grid": ["vector_answers", "items"],
    "vector_scored": ["vector_pairs", "vector_grid"],
    "vector_solutions_all": ["items"],
    "vector_pairs_all": ["vector_answers", "items", "vector_solutions_all"],
    "vector_scored_all": ["vector_pairs_all", "vector_grid"],
    "vector_grading": ["vector_scored", "vector_answers"],
    "train": ["vector_grading"],
    "anchored": ["train"],
    "anchored_by_exam": ["train"],
    "model": ["anchored"],
    "model_by_exam": ["anchored_by_exam"],
    "anchored_but_one": ["train", "vector_scored"],
    "model_but_one": ["anchored_but_one"],
    "predicted": ["vector_scored", "model"],
}


def _sql(body: str, *views: str) -> str:
    wanted: set[str] = set()

    def add(name: str) -> None:
        wanted.add(name)
        for other in _NEEDS.get(name, []):
            add(other)

    for view in views:
        add(view)
    ctes = [f"{name} AS ({text})" for name, text in _CTE.items() if name in wanted]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


# --- papers, written out once more in SQL

_HEADER = (
    "'\n' || '\n' || '\n' || 'front_F1R5T_N4M3First nameend_F1R5T_N4M3:' || {first} || '\n'"
    " || 'front_5URN4M3Surnameend_5URN4M3:' || {surname} || '\n'"
    " || 'front_5TUD3NT_1DStudent IDend_5TUD3NT_1D:' || {student} || '\n' || '\n' || '\n'"
)


def _header(title: str, first: str = "''", surname: str = "''", student: str = "''") -> str:
    return f"{title} || " + _HEADER.format(first=first, surname=surname, student=student)


_TEACHER_BLOCK = f"""
    'front_QU35T10N ' || q_no || ' Question ' || q_no || ':end_QU35T10N ' || q_no || '\n' || question || '\n'
    || 'front_4N5W3R ' || q_no || ' Answer ' || q_no || ':end_4N5W3R ' || q_no || '\n' || sample_solution || '\n'
    || 'front_41T ' || q_no || 'Alternative Solution ' || q_no || ':end_41T ' || q_no || '\n'
    || alternative_solution || '\n'
    || 'front_P01NT5 ' || q_no || ' Points for Question ' || q_no || ': end_P01NT5 ' || q_no || '\n'
    || {_points_text('points')} || '\n' || '\n'"""


def _student_block(answer: str) -> str:
    return f"""
    'front_QU35T10N ' || q_no || ' Question ' || q_no || ': end_QU35T10N ' || q_no || '\n' || question || '\n'
    || 'front_4N5W3R ' || q_no || ' Answer ' || q_no || ': end_4N5W3R ' || q_no || '\n' || {answer} || '\n'
    || 'front_P01NT5 ' || q_no || ' Points for Question ' || q_no || ': end_P01NT5 ' || q_no || '\n'
    || {_points_text('points')} || '\n' || '\n'"""


_TEACHER = f"""
    SELECT exam_id, {_header("exam_id || ' Sample Solution'")}
      || string_agg({_TEACHER_BLOCK}, '\n' ORDER BY q_no) AS text FROM items GROUP BY exam_id"""
_STUDENT = f"""
    SELECT exam_id, {_header('exam_id')}
      || string_agg({_student_block("''")}, '\n' ORDER BY q_no) AS text FROM items GROUP BY exam_id"""
_ANSWERED_PAPER = f"""
    SELECT exam_id, student_id,
           {_header('exam_id', "' ' || first_name", "' ' || surname", "' ' || student_id")}
           || string_agg({_student_block('student_solution')}, '\n' ORDER BY q_no) AS text
    FROM evaluation GROUP BY exam_id, student_id, first_name, surname"""
_PATH = "'papers/' || exam_id || '/' || student_id || '.docx' AS path"
_SLOT = "exam_id, student_id, q_no"

# --- prompts and replies

_SCHEME = {
    "full_points": "full points like 0, 1 or 2",
    "half_points": "full points or half points like 0, 0.5 or 1",
    "quarter_points": "full points or quarter points like 0, 0.25 or 0.5",
}


def _grading_prompt(scheme: str) -> str:
    return f"""'You are a teacher grading exam questions, please provide a score from 0 to '
    || {_points_text('points')} || ' for the following student answer. Use the following grading scheme: '
    || '{_SCHEME[scheme]}. Question: ' || question || ', Student Solution: ' || student_solution
    || ', Sample Solution: ' || solution
    || ', Cosine Similarity between sample solution and student solution: '
    || printf('%.6f', {_six('cosine_similarity')}) || ', Score:'"""


_FEEDBACK_PROMPT = f"""'You are a teacher grading exam questions, please explain the number of points a '
    || 'student has received based on the question, sample solution, and student answer. Provide short '
    || 'feedback why this student has received ' || CAST(awarded AS VARCHAR) || ' points out of '
    || {_points_text('points')} || ' total points for the following student answer. Question: '
    || question || ', Student Solution: ' || student_solution || ', Sample Solution: ' || solution
    || ', Feedback:'"""

_W = r"\t-\r\x{85}\p{Z}"


def _tokens(text: str) -> str:
    """Pre-tokens. The engine has no look-ahead: the last white space in front of
    other text is marked first and the mark taken into the pattern."""
    marked = f"regexp_replace({text}, '([{_W}])([^{_W}])', chr(1) || '\\1\\2', 'g')"
    pattern = (
        r"''s|''t|''re|''ve|''m|''ll|''d|(?:\x01 )?\p{L}+|(?:\x01 )?\p{N}+"
        rf"|(?:\x01 )?[^{_W}\p{{L}}\p{{N}}\x01]+|\x01[{_W}]|[{_W}]+"
    )
    return f"regexp_extract_all({marked}, '{pattern}')"


def _cut(text: str, budget: str) -> str:
    return f"replace(array_to_string(({_tokens(text)})[1:{budget}], ''), chr(1), '')"


_RESPONSES = """(SELECT doc_id, text AS prompt,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END
    || [' 1.5 points. Good. rest', ' .5', ' Score -5', ' no number', ''][doc_id % 5 + 1] AS reply
    FROM documents)"""
_ENDING = "[' 1.5 points. Good. rest', ' .5', ' Score -5', ' no number', ''][length({p}) % 5 + 1]"
_STRIPPED = f"""(SELECT doc_id, trim(CASE WHEN strpos(reply, prompt) > 0
      THEN substr(reply, strpos(reply, prompt) + length(prompt)) ELSE reply END, {_WS}) AS feedback
    FROM {_RESPONSES})"""
_NUMBER = r"'[-+]?\d*\.\d+|\d+'"
_SCORE = f"TRY_CAST(nullif(regexp_extract(feedback, {_NUMBER}), '') AS DOUBLE)"
_CLEAN = f"""CASE WHEN contains(feedback, '.')
    THEN substr(feedback, 1, length(feedback) - strpos(reverse(feedback), '.') + 1)
    ELSE rtrim(feedback, {_WS}) || '.' END"""
_SHEET = "surname, first_name, student_id, question, points, solution, student_solution"


def _ceil(value: str, steps: int) -> str:
    return f"ceil(round({value}, 9) * {steps}) / {steps}"


def _lineitem(value: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, {_six(value)} AS points FROM lineitem"


def _draw(seed: int, key: str = "identification") -> str:
    return f"md5({key} || ':{seed}')"


_POOL = f"(SELECT * FROM vector_scored WHERE {_answered()})"
_LINE = "l_quantity * l_discount"
_LETTERS = "[" + ", ".join(
    f"CAST(length({{t}}) - length(replace({{t}}, '{chr(c)}', '')) AS DOUBLE)" for c in range(97, 123)
) + "]"
_HALF = f"CASE WHEN {_answered()} THEN {_ceil('points * relative_points', 2)} ELSE 0.0 END"

ORACLES: dict[str, str] = {
    # sources and sinks
    "ingest_docs": _sql(f"SELECT {_PATH}, text FROM ({_ANSWERED_PAPER})", "evaluation"),
    "filter_extension": """
        SELECT doc_id, 'papers/' || source || '/' || doc_id || '.docx' AS path
        FROM documents WHERE lang = 'en'""",
    "append_items": _sql("""
        SELECT exam_id, q_no, question, sample_solution, alternative_solution, points FROM items
        UNION ALL SELECT 'R' || exam_id, q_no, question, sample_solution, '', points FROM items""", "items"),
    "render_teacher": _sql(_TEACHER, "items"),
    "render_student": _sql(_STUDENT, "items"),
    "render_student_named": _sql(f"""
        SELECT i.exam_id, r.student_id,
               {_header('i.exam_id', "' ' || r.first_name", "' ' || r.surname", "' ' || r.student_id")}
               || string_agg({_student_block("''")}, '\n' ORDER BY q_no) AS text
        FROM roster r JOIN items i ON i.exam_id = r.exam_id
        GROUP BY i.exam_id, r.student_id, r.first_name, r.surname""", "roster", "items"),
    "render_bundle": _sql(f"""
        SELECT 'teacher' AS variant, exam_id, text FROM ({_TEACHER})
        UNION ALL SELECT 'student', exam_id, text FROM ({_STUDENT})""", "items"),
    "stage_roundtrip": _sql("SELECT * FROM evaluation", "evaluation"),
    "sheet_generative": _sql(f"""
        SELECT {_SHEET},
               CASE WHEN {_answered()} THEN {_SCORE} ELSE 0.0 END AS points_for_student_answer,
               CASE WHEN {_answered()} THEN feedback ELSE 'Question has not been answered' END AS feedback
        FROM (SELECT *, trim([' 1.5 points. Good. rest', ' .5', ' Score -5', ' no number', '']
                             [identification % 5 + 1]) AS feedback FROM vector_scored)""", "vector_scored"),
    "sheet_similarity": _sql(f"""
        SELECT {_SHEET}, {_six('points * relative_points')} AS points_for_student_answer
        FROM predicted""", "predicted"),
    # projections, casts, conditional values
    "project_eval": _sql("""
        SELECT first_name, surname, student_id, question, points, sample_solution,
               alternative_solution, student_solution FROM evaluation""", "evaluation"),
    "cast_text": """
        SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "cast_points": """
        SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE quality + 0.25::DOUBLE END AS points FROM labels""",
    "zero_unanswered": _sql(f"""
        SELECT {_SLOT}, CASE WHEN {_answered()} THEN points ELSE 0.0 END AS points FROM evaluation""",
        "evaluation"),
    "default_alternative": _sql("SELECT * EXCLUDE (item_id) FROM items", "items"),
    "relative_points": _sql(f"""
        SELECT {_SLOT}, CASE WHEN points <> 0 THEN {_six('CAST(grading AS DOUBLE) / points')} END
          AS relative_points FROM gradings""", "gradings"),
    "number_items": _sql("""
        SELECT item_id, exam_id, question,
               CAST(row_number() OVER (PARTITION BY exam_id ORDER BY item_id) AS INTEGER) AS q_no
        FROM items""", "items"),
    # filters
    "split_answered": _sql(f"""
        SELECT {_SLOT}, student_solution FROM evaluation WHERE {_answered()}""", "evaluation"),
    "split_unanswered": _sql(f"""
        SELECT {_SLOT}, question, points FROM evaluation WHERE NOT {_answered()}""", "evaluation"),
    "rejected_answers": _sql("""
        SELECT a.doc_id, a.exam_id,
               CAST(CASE WHEN a.doc_id % 19 = 0 THEN a.q_no + 1000 ELSE a.q_no END AS INTEGER) AS q_no,
               CASE WHEN l.doc_id IS NULL THEN 'no such question' ELSE 'no student id' END AS reason
        FROM answers a LEFT JOIN labels l ON l.doc_id = a.doc_id
        WHERE l.doc_id IS NOT NULL OR a.doc_id % 19 = 0""", "answers"),
    "training_rows": _sql(f"""
        SELECT identification, grading, points AS points_x,
               {_six('cosine_similarity')} AS cosine_similarity
        FROM vector_grading WHERE grading <> '' AND points <> 0""", "vector_grading"),
    "validate_grading": _sql(f"""
        SELECT {_SLOT}, points, entered AS grading,
               least(TRY_CAST(entered AS DOUBLE), points + CASE WHEN entered = 'none' THEN NULL ELSE 0 END)
                 AS grading_value, entered <> 'none' AS is_valid
        FROM (SELECT *, CASE WHEN grading = '0.0' THEN 'none'
                ELSE CAST(CAST(grading AS DOUBLE) * 2 AS VARCHAR) END AS entered FROM gradings)""",
        "gradings"),
    "validate_items": """
        SELECT doc_id, lang IN ('en', 'de') AND n_chars >= 300 AND n_chars % 3 = 0 AS is_valid
        FROM documents""",
    # extraction gives back what was written
    "extract_questions": _sql(f"SELECT exam_id, q_no, trim(question, {_WS}) AS question FROM items", "items"),
    "extract_sample": _sql(f"""
        SELECT exam_id, q_no, trim(sample_solution, {_WS}) AS sample_solution FROM items""", "items"),
    "extract_alternative": _sql(f"""
        SELECT exam_id, q_no, trim(alternative_solution, {_WS}) AS alternative_solution FROM items""", "items"),
    "extract_points": _sql("SELECT exam_id, q_no, points FROM items", "items"),
    "extract_identity": _sql(
        f"SELECT {_PATH}, exam_id, student_id, first_name, surname FROM roster", "roster"),
    "extract_answers": _sql(f"""
        SELECT {_PATH}, exam_id, q_no, trim(student_solution, {_WS}) AS student_solution
        FROM evaluation""", "evaluation"),
    "count_questions": _sql(f"""
        SELECT {_PATH}, CAST(count(*) AS INTEGER) AS n_questions
        FROM evaluation GROUP BY exam_id, student_id""", "evaluation"),
    "extract_items": _sql(f"""
        SELECT exam_id, q_no, trim(question, {_WS}) AS question,
               trim(sample_solution, {_WS}) AS sample_solution,
               trim(alternative_solution, {_WS}) AS alternative_solution, points FROM items""", "items"),
    "extract_student_table": _sql(f"""
        SELECT exam_id, student_id, first_name, surname, q_no,
               trim(student_solution, {_WS}) AS student_solution FROM evaluation""", "evaluation"),
    "read_papers": _sql(f"""
        SELECT exam_id, student_id, first_name, surname, q_no,
               trim(student_solution, {_WS}) AS student_solution FROM evaluation""", "evaluation"),
    # joins
    "align_answers": _sql("""
        SELECT a.exam_id, a.student_id, a.first_name, a.surname, a.q_no, a.student_solution,
               i.question, i.points, i.sample_solution, i.alternative_solution
        FROM answers a JOIN items i ON i.exam_id = a.exam_id AND i.q_no = a.q_no""", "answers", "items"),
    "student_item_grid": _sql("""
        SELECT r.exam_id, r.student_id, i.q_no, r.first_name, r.surname, i.points
        FROM roster r JOIN items i ON i.exam_id = r.exam_id""", "roster", "items"),
    "evaluation_table": _sql("""
        SELECT r.exam_id, r.student_id, i.q_no, i.points,
               coalesce(a.student_solution, '') AS student_solution
        FROM (SELECT DISTINCT exam_id, student_id FROM answers WHERE q_no % 3 <> 0) r
        JOIN items i ON i.exam_id = r.exam_id
        LEFT JOIN (SELECT * FROM answers WHERE q_no % 3 <> 0) a
          ON a.exam_id = r.exam_id AND a.student_id = r.student_id AND a.q_no = i.q_no""",
        "answers", "items"),
    "join_gradings": _sql(f"""
        SELECT identification, grading, points AS points_x, points AS points_y,
               question AS question_x, solution AS solution_y,
               {_six('cosine_similarity')} AS cosine_similarity FROM vector_grading""", "vector_grading"),
    "fill_blank_solution": _sql(f"""
        SELECT {_SLOT}, question,
               CASE WHEN alternative_solution = '' THEN sample_solution ELSE alternative_solution END
                 AS solution
        FROM evaluation""", "evaluation"),
    "pool_minus_sample": _sql(f"""
        SELECT identification FROM (
          SELECT identification, row_number() OVER (ORDER BY {_draw(SEED)}, identification) AS place
          FROM {_POOL}) WHERE place > 10""", "vector_scored"),
    "upsert_gradings": _sql("""
        SELECT identification, question, points, solution, student_solution, grading
        FROM vector_grading""", "vector_grading"),
    "pair_similarity": _sql(f"""
        SELECT {_SLOT}, solution_type, {_six('cosine_similarity')} AS cosine_similarity
        FROM vector_pairs""", "vector_pairs"),
    # aggregations
    "max_questions": _sql("""
        SELECT CAST(max(n) AS INTEGER) AS max_questions
        FROM (SELECT count(*) AS n FROM evaluation GROUP BY exam_id, student_id)""", "evaluation"),
    "count_papers": _sql("SELECT count(*) AS n_papers FROM roster", "roster"),
    "best_solution": _sql(f"""
        SELECT {_SLOT}, solution_type, solution, {_six('cosine_similarity')} AS cosine_similarity
        FROM vector_scored WHERE {_answered()}""", "vector_scored"),
    "distinct_questions": _sql("SELECT DISTINCT question FROM evaluation", "evaluation"),
    "solutions_by_question": _sql("""
        SELECT question, sample_solution AS solution, min(exam_id) AS first_exam_id,
               CAST(min(q_no) AS INTEGER) AS first_q_no FROM items GROUP BY ALL""", "items"),
    "fit_quadratic": _sql(f"""
        SELECT {_six('b0')} AS b0, {_six('b1')} AS b1, {_six('b2')} AS b2, n, degenerate
        FROM model""", "model"),
    "fit_quadratic_by_exam": _sql(f"""
        SELECT exam_id, {_six('b0')} AS b0, {_six('b1')} AS b1, {_six('b2')} AS b2, n, degenerate
        FROM model_by_exam""", "model_by_exam"),
    "slots_in_buckets": _sql(f"""
        SELECT {', '.join(f's.{c}' for c in ('exam_id', 'student_id', 'q_no'))}, a.vec_id, {_six('s.cosine_similarity')} AS cosine_similarity,
               CASE WHEN a.vec_id % 3 = 0
                 THEN CAST(least(CAST(a.vec_id % 5 AS DOUBLE), CAST((a.vec_id - 2 * {_N}) % {_N} % 5 AS DOUBLE)) AS VARCHAR)
                 ELSE '' END AS grading
        FROM vector_scored s JOIN vector_answers a ON a.exam_id = s.exam_id
          AND a.student_id = s.student_id AND a.q_no = s.q_no""", "vector_scored"),
    "fit_by_steps": _sql(f"""
        SELECT exam_id, {_six('b0')} AS b0, {_six('b1')} AS b1, {_six('b2')} AS b2, n, degenerate
        FROM model_by_exam""", "model_by_exam"),
    "mean_pool": f"""
        SELECT label, pos, {_six('avg(v)')} AS mean_value FROM (
          SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v,
                 CAST(unnest(range(len(embedding))) AS INTEGER) AS pos FROM embeddings)
        GROUP BY label, pos""",
    # numbering, order, samples
    "identification": _sql(f"""
        SELECT {_SLOT}, solution_type,
               dense_rank() OVER (ORDER BY exam_id, student_id, q_no) - 1 AS identification
        FROM word_pairs""", "word_pairs"),
    "lasting_identification": _sql(f"""
        SELECT {_SLOT}, row_number() OVER (
          ORDER BY CAST(student_id AS INTEGER) % 3, exam_id, student_id, q_no) - 1 AS identification
        FROM (SELECT DISTINCT {_SLOT} FROM word_pairs)""", "word_pairs"),
    "sort_sheet": _sql("SELECT surname, first_name, identification FROM vector_scored", "vector_scored"),
    "sample_training": _sql(f"""
        SELECT identification, question, student_solution FROM {_POOL}
        ORDER BY {_draw(SEED)}, identification LIMIT 2""", "vector_scored"),
    "shuffle_rows": f"SELECT doc_id, {_draw(SEED, 'doc_id')} AS draw FROM documents",
    "initial_split": _sql(f"""
        SELECT identification, CASE WHEN place <= 2 THEN 'grading' ELSE 'pool' END AS part FROM (
          SELECT identification, row_number() OVER (ORDER BY {_draw(SEED)}, identification) AS place
          FROM {_POOL})""", "vector_scored"),
    "grow_training_set": _sql(f"""
        SELECT identification,
               CASE WHEN first = 'grading' OR place = 1 THEN 'grading' ELSE 'pool' END AS part
        FROM (
          SELECT *, row_number() OVER (PARTITION BY first ORDER BY {_draw(SEED + 1)}, identification) AS place
          FROM (
            SELECT identification, CASE WHEN place <= 2 THEN 'grading' ELSE 'pool' END AS first FROM (
              SELECT identification, row_number() OVER (ORDER BY {_draw(SEED)}, identification) AS place
              FROM {_POOL})))""", "vector_scored"),
    # putting together, reshaping
    "reunite_unanswered": _sql(f"""
        SELECT {_SLOT}, s.solution_type, s.solution, CAST(NULL AS DOUBLE) AS cosine_similarity
        FROM evaluation e JOIN solutions s USING (exam_id, q_no) WHERE {_answered()}
        UNION ALL
        SELECT {_SLOT}, 'Sample Solution', sample_solution, 0.0
        FROM evaluation WHERE NOT {_answered()}""", "evaluation", "solutions"),
    "anchor_points": _sql(f"SELECT {_six('x')} AS x, {_six('y')} AS y FROM anchored", "anchored"),
    "training_points": _sql(f"SELECT {_six('x')} AS x, {_six('y')} AS y FROM train", "train"),
    "melt_solutions": _sql(f"""
        SELECT {_SLOT}, student_solution, s.solution_type, s.solution
        FROM evaluation e JOIN solutions s USING (exam_id, q_no) WHERE {_answered()}""",
        "evaluation", "solutions"),
    # scalar functions
    "fn_strip": f"SELECT doc_id, trim(text, {_WS}) AS stripped FROM documents",
    "fn_replace": "SELECT page_id, replace(url, ':', '') AS without FROM pages",
    "round_full": _lineitem(_ceil(_LINE, 1)),
    "round_half": _lineitem(_ceil(_LINE, 2)),
    "round_quarter": _lineitem(_ceil(_LINE, 4)),
    "round_none": _lineitem(_LINE),
    "fn_cosine": f"""
        SELECT a.vec_id, {_six('list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))')} AS cosine
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "poly_features": f"""
        SELECT l_orderkey, l_linenumber, l_discount, {_six('l_discount')} AS x1,
               {_six('l_discount * l_discount')} AS x2 FROM lineitem""",
    # embedding, scoring, calibration
    "embed_precomputed": _sql(f"""
        SELECT {_SLOT}, solution_type, {_six('cosine_similarity')} AS cosine_similarity
        FROM vector_pairs""", "vector_pairs"),
    "bow_cosine": _sql(f"""
        SELECT {_SLOT}, solution_type, {_six('cosine_similarity')} AS cosine_similarity
        FROM word_pairs""", "word_pairs"),
    "embed_udf": _sql(f"""
        SELECT {_SLOT}, CASE WHEN isnan(c) THEN 0.0 ELSE {_six('c')} END AS cosine_similarity
        FROM (SELECT *, list_cosine_similarity({_LETTERS.format(t='student_solution')},
                                               {_LETTERS.format(t='sample_solution')}) AS c
              FROM evaluation WHERE {_answered()})""", "evaluation"),
    "score_answers": _sql(f"""
        SELECT * REPLACE ({_six('cosine_similarity')} AS cosine_similarity) FROM vector_scored""",
        "vector_scored"),
    "score_answers_text": _sql(f"""
        SELECT * REPLACE ({_six('cosine_similarity')} AS cosine_similarity) FROM word_scored""",
        "word_scored"),
    "score_answers_encoder": _sql(f"""
        SELECT {_SLOT}, solution_type, {_six('similarity')} AS cosine_similarity, identification
        FROM (
          SELECT *, dense_rank() OVER (ORDER BY exam_id, student_id, q_no) - 1 AS identification,
                 row_number() OVER (PARTITION BY exam_id, student_id, q_no
                                    ORDER BY similarity DESC, type_rank) AS place
          FROM (
            SELECT {_SLOT}, solution_type, type_rank,
                   CASE WHEN isnan(c) OR NOT answered THEN 0.0 ELSE c END AS similarity
            FROM (SELECT e.exam_id, e.student_id, e.q_no, s.solution_type, s.type_rank,
                         {_answered('e.student_solution')} AS answered,
                         list_cosine_similarity({_LETTERS.format(t='e.student_solution')},
                                                {_LETTERS.format(t='s.solution')}) AS c
                  FROM evaluation e JOIN solutions s ON s.exam_id = e.exam_id AND s.q_no = e.q_no)))
        WHERE place = 1""", "evaluation", "solutions"),
    "score_answers_blank_kept": _sql(f"""
        SELECT s.exam_id, s.student_id, s.q_no, solution_type,
               CASE WHEN s.solution = '' THEN i.sample_solution ELSE s.solution END AS solution,
               {_six('cosine_similarity')} AS cosine_similarity, identification
        FROM vector_scored_all s JOIN items i ON i.exam_id = s.exam_id AND i.q_no = s.q_no""",
        "vector_scored_all", "items"),
    "fit_curve": _sql(f"""
        SELECT {_six('i / 99.0::DOUBLE')} AS x,
               {_six('b0 + b1 * (i / 99.0::DOUBLE) + b2 * (i / 99.0::DOUBLE) * (i / 99.0::DOUBLE)')} AS y
        FROM model, range(100) t(i)""", "model"),
    "predict_relative": _sql(f"""
        SELECT identification, {_six('least(greatest(relative_points, 0.0), 1.0)')} AS relative_points
        FROM predicted""", "predicted"),
    "calibrate": _sql(f"""
        SELECT * REPLACE ({_six('cosine_similarity')} AS cosine_similarity,
                          {_six('relative_points')} AS relative_points) FROM predicted""", "predicted"),
    "calibrate_by_exam": _sql(f"""
        SELECT identification, CASE WHEN {_answered()}
          THEN {_six('b0 + b1 * cosine_similarity + b2 * cosine_similarity * cosine_similarity')}
          ELSE 0.0 END AS relative_points
        FROM vector_scored s LEFT JOIN model_but_one m ON m.exam_id = s.exam_id""",
        "vector_scored", "model_but_one"),
    "grade_papers_rejects": _sql("""
        SELECT exam_id, student_id, q_no, md5(student_solution) AS answer_md5,
               CASE WHEN student_id = '' THEN 'no student id' WHEN q_no > 1000 THEN 'no such question'
                    ELSE 'another answer is graded' END AS reason
        FROM (SELECT *, row_number() OVER (PARTITION BY exam_id, student_id, q_no
                                           ORDER BY student_solution <> '' DESC) AS place
              FROM (SELECT exam_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE student_id END AS student_id,
                           CAST(CASE WHEN doc_id % 11 = 0 THEN q_no + 1000 ELSE q_no END AS INTEGER) AS q_no,
                           unnest(CASE WHEN doc_id % 7 = 0 THEN [student_solution, ''] ELSE [student_solution] END)
                             AS student_solution
                    FROM answers))
        WHERE student_id = '' OR q_no > 1000 OR place > 1""", "answers"),
    "similarity_scores": _sql(
        f"SELECT {_SHEET}, {_HALF} AS points_for_student_answer FROM predicted", "predicted"),
    # generated scores and feedback
    "prompt_grading": _sql(f"""
        SELECT identification, {_grading_prompt('full_points')} AS prompt FROM {_POOL}""", "vector_scored"),
    "prompt_feedback": _sql(f"""
        SELECT identification, {_FEEDBACK_PROMPT} AS prompt
        FROM (SELECT *, {_HALF} AS awarded FROM predicted) WHERE {_answered()}""", "predicted"),
    "truncate_prompt": f"SELECT doc_id, {_cut('text', '924')} AS prompt FROM documents",
    "truncate_prompt_keep_suffix": f"""
        SELECT doc_id, CASE WHEN len({_tokens('text')}) <= 200 THEN text
          ELSE {_cut('text', '198')} || ' Score:' END AS prompt FROM documents""",
    "generate_stub": f"""
        SELECT doc_id, text || {_ENDING.format(p='text')} AS generated_text FROM documents""",
    "generate_once": f"""
        SELECT doc_id, text || {_ENDING.format(p='text')} AS generated_text FROM documents""",
    "strip_echo": f"SELECT doc_id, feedback FROM {_STRIPPED}",
    "parse_score": f"SELECT doc_id, {_SCORE} AS points_for_student_answer FROM {_STRIPPED}",
    "parse_score_clamped": f"""
        SELECT doc_id, CASE WHEN score IS NOT NULL
          THEN least(greatest(score, 0.0), CAST(doc_id % 2 AS DOUBLE)) END AS points_for_student_answer
        FROM (SELECT doc_id, {_SCORE} AS score FROM {_STRIPPED})""",
    "clean_feedback": f"SELECT doc_id, {_CLEAN} AS feedback FROM {_STRIPPED}",
    "unanswered_feedback": _sql(f"""
        SELECT {_SLOT}, CASE WHEN {_answered()} THEN question ELSE 'Question has not been answered' END
                 AS feedback, CASE WHEN {_answered()} THEN points ELSE 0.0 END AS points_for_student_answer
        FROM evaluation""", "evaluation"),
    "scheme_text": f"""
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '{_SCHEME['full_points']}'
          WHEN 'MACHINERY' THEN '{_SCHEME['half_points']}' ELSE '{_SCHEME['quarter_points']}' END AS scheme
        FROM customer""",
    "generative_scores": _sql(f"""
        SELECT {_SHEET}, CASE WHEN {_answered()} THEN {_SCORE} ELSE 0.0 END AS points_for_student_answer,
               CASE WHEN {_answered()} THEN feedback ELSE 'Question has not been answered' END AS feedback
        FROM (SELECT *, trim({_ENDING.format(p='prompt')}) AS feedback FROM (
          SELECT *, {_cut(_grading_prompt('quarter_points'), '924')} AS prompt FROM word_scored))""",
        "word_scored"),
    "explained_scores": _sql(f"""
        SELECT {_SHEET}, awarded AS points_for_student_answer,
               CASE WHEN {_answered()} THEN {_CLEAN} ELSE 'Question has not been answered' END AS feedback
        FROM (SELECT *, trim({_ENDING.format(p='prompt')}) AS feedback FROM (
          SELECT *, {_cut(_FEEDBACK_PROMPT, '924')} AS prompt FROM (
            SELECT *, {_HALF} AS awarded FROM predicted)))""", "predicted"),
}

# From papers to the sheet: the same scores on stripped texts, calibrated on the labels.
ORACLES["papers_in_steps"] = _sql(f"""
    SELECT {_SLOT}, solution_type, {_six('cosine_similarity')} AS cosine_similarity, row_number() OVER (
      ORDER BY CAST(student_id AS INTEGER) % 2, exam_id, student_id, q_no) - 1 AS identification
    FROM word_scored""", "word_scored")

ORACLES["grade_papers"] = _sql(f"""
    , paper_train AS (
      SELECT s.cosine_similarity AS x, CAST(g.grading AS DOUBLE) / s.points AS y
      FROM word_scored s JOIN gradings g USING (exam_id, student_id, q_no)
      WHERE {_answered()} AND s.points <> 0
      UNION ALL VALUES (0.0, 0.0), (1.0, 1.0)),
    paper_model AS ({_fit('paper_train')})
    SELECT surname, first_name, student_id, trim(question, {_WS}) AS question, points,
           trim(solution, {_WS}) AS solution, trim(student_solution, {_WS}) AS student_solution,
           CASE WHEN {_answered()} THEN
             {_ceil('points * (b0 + b1 * cosine_similarity + b2 * cosine_similarity * cosine_similarity)', 4)}
             ELSE 0.0 END AS points_for_student_answer
    FROM word_scored, paper_model""", "word_scored", "gradings").replace(")     , paper_train", "), paper_train")

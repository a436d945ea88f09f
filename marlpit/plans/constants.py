"""What the registered queries ask."""

from __future__ import annotations

QUERY = "The of inest thion and the option"
KEYWORDS = ["the", "tion", "Of", "the", "and"]
KNOWN_TERMS = ["the", "ing", "secret", "que"]
MEMORY_QUERY = "User"
PROBE = 7
KNOWN = 50
NODE = "nation-3"
DOCUMENT = "DOC-000042"
LOOKED_UP = (7, 10, 42, 60, 999_999)
UNRULED_FORMS = (None, None, None)
FORMS = ("x", None, "x")
FRAME_HEAD = " \tCARE Knowledge  Base\nrecent posts\nEnter a search term and go\n\n\n"
FRAME_TAIL = "\n\nAll categories Search\t 📝 CATEGORIES end \n"
PREFIXES = ("", "Show the logs: ", "update tracker and logs ", "Which HOTEL ")
EXTENSIONS = ("", ".PDF", ".docx", ".txt", ".tar.gz", ".html")
#: Questions besides the benchmark's texts, of which memory holds some only in its context.
ASKED_OF_MEMORY = ((-1, "USER_FEEDBACK"), (-2, "document 7"), (-3, "toxic"), (-4, "true"), (-5, "no such thing"))
#: Texts that are looked for in all turns, short ones and one of no turn among them.
NEEDLES = ("a", "th", "the", "ser", "assist", "e t", "no such thing")
RULES = (
    ("Process", ("the and", "process", "ment")),
    ("Upload", ("full upload", "ingre")),
    ("Troubleshooting", ("error", "Failure", "edth")),
)
# Fixed values of the self-test, which measures nothing.
SELF_TEST = {"memory_retrieval_accuracy": 0.92, "pattern_recognition_rate": 0.87, "response_time_ms": 150.5, "feedback_processing_rate": 0.95}
FEW_RULES = "Low number of pattern recognition rules"

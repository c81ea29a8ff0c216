"""Lists that the operators ask for, as short as the test tables need."""

INBOXES = ["info", "sales", "office", "customerservice"]
NOT_A_NAME = ["our", "team", "the", "and", "insurance"]
COMPETITORS = ["and then", "sage"]
STOPWORDS = ["about", "there", "which", "would"]
DIMENSIONS = ["fit", "reach", "complexity", "growth", "contact", "timing"]
PAGE_COLUMNS = [
    ("ref_no", 40.0), ("intermediary", 100.0), ("registered_as", 230.0), ("registered_on", 350.0),
    ("tied_to", 440.0), ("persons_responsible", 600.0), ("passporting_into", 715.0),
]

"""Word lists, phrases, patterns and formats that results depend on."""

# Stop words, looked up after normalisation.
AR_STOP_WORDS = [
    "ما", "ماذا", "كيف", "هل", "في", "من", "على", "الى", "إلى", "عن", "و", "او", "أو",
    "هو", "هي", "هم", "هذه", "هذا", "ذلك", "تلك", "كل", "بين", "مع", "ل", "ال", "اي", "أي",
    "الذي", "التي", "ثم", "بعد", "قبل", "هناك", "هنا", "انه", "إنه", "ان", "إن", "كان", "كانت",
    "دي", "ده", "دا", "يعني", "بس", "اووي", "اوي", "كده", "كدا",
    "عايز", "عاوز", "ممكن", "لو", "لو سمحت", "حابب", "ابي", "ودي", "عندي",
    "فيه", "فية", "فيها", "منين", "فين", "امتى", "ليه", "ازاي",
]
EN_STOP_WORDS = [
    "what", "how", "is", "are", "the", "a", "an", "of", "to", "in", "on", "for", "and",
    "or", "between", "about", "explain", "tell", "me", "does", "do", "be", "types",
    "define", "definition", "difference", "compare", "give", "show", "list", "summary",
    "this", "that", "these", "those", "with", "from", "into", "by", "it", "please",
    "can", "could", "would", "should", "may", "might", "will", "shall",
    "i", "you", "we", "they", "my", "your", "our", "their", "its",
]

# Phrases that need no retrieval, by category.
SMALL_TALK = {
    "greeting": [
        "hi", "hello", "hi there", "hello there", "hey", "hey there", "yo", "sup",
        "good morning", "good afternoon", "good evening", "good night",
        "how are you", "hows it going", "how's it going", "what's up", "whats up",
        "مرحبا", "اهلا", "أهلا", "هاي", "السلام عليكم", "صباح الخير", "مساء الخير",
        "ازيك", "عامل ايه", "عاملة ايه", "كيف حالك", "كيفك",
    ],
    "thanks": [
        "thanks", "thank you", "thanks a lot", "thank you so much", "thx", "ty",
        "appreciate it", "much appreciated",
        "شكرا", "متشكر", "متشكرة", "يسلمو", "تسلم", "تسلمي", "الله يسلمك",
    ],
    "farewell": ["bye", "goodbye", "see you", "see you later", "take care", "باي", "مع السلامة", "تصبح على خير"],
    "ack": ["ok", "okay", "cool", "great", "nice", "got it", "sounds good", "awesome", "تمام", "حلو", "كويس", "اوك", "ماشي"],
    "identity": ["who are you", "what can you do", "what is your name", "whats your name", "مين انت", "اسمك ايه", "تقدر تعمل ايه"],
    "memory": [
        "what did i ask", "what did i ask you", "what did i just ask", "what did i ask before", "what did i ask you before",
        "what did you say", "can you repeat that", "can you repeat", "ايه اللي سألتك", "قولتلك ايه", "تقدر تعيد",
    ],
}

# Answers that say that nothing was found.
REFUSALS = [
    "not available in the uploaded files", "غير موجودة في الملفات المرفوعة", "only answers questions about the uploaded documents",
    "لا يجيب إلا عن أسئلة", "no relevant documents were found", "لا توجد مستندات كافية للإجابة",
]
NOT_FOUND = {"en": "The information is not available in the uploaded files.", "ar": "المعلومة غير موجودة في الملفات المرفوعة."}

# Openings that an answer's line loses.
BANNED_OPENINGS = ["Sources:", "Source:", "المصادر:", "المصدر:", "Based on the context,", "According to the context,", "بناءً على السياق،", "وفقاً للمعلومات المتاحة،"]

# File types and their content types.
FILE_TYPES = {
    "pdf": "pdf", "docx": "docx", "doc": "doc", "txt": "txt", "md": "markdown", "json": "json",
    "jpg": "image", "jpeg": "image", "png": "image", "tiff": "image", "bmp": "image", "webp": "image",
    "xlsx": "excel", "xls": "excel", "csv": "excel",
}
CONTENT_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword", "txt": "text/plain",
    "markdown": "text/markdown", "json": "application/json", "image": "application/octet-stream",
    "excel": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
CONTENT_TYPES_BY_EXTENSION = {"xls": "application/vnd.ms-excel", "csv": "text/csv"}

# The order of report sections and their caps.
REPORT_SECTIONS = ["key_points", "definitions", "technical_terms", "numbers", "equations", "best_practices", "figures_tables"]
REPORT_CAPS = [40, 40, 50, 40, 30, 30, 30]

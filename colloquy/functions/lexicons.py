"""Word lists, patterns and thresholds that results depend on. Patterns are Java regular expressions."""

#: Speaker markers, dialogue prefixes, self-introductions, timestamps and clues in transcript lines.
SPEAKER_MARKER = r"(?U)\*\*Speaker\s+(\d+)\*\*"
DIALOGUE_PREFIX = r"(?U)^\s*(?:\*\*)?([A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9 .,_\-]{0,40})(?:\*\*)?\s*:"
CYRILLIC = r"[\u0400-\u04FF\u1C80-\u1C8F]"
INTRODUCTION = (
    r"(?iu)(меня зовут|мне зовут|расскажи про себя|расскажите про себя|"
    r"представься|представьтесь|представь себя|представьте себя|"
    r"я .*кодер|я .*предприниматель|я .*разработчик|кто ты такой|кто вы такой)"
)
TIMESTAMP = r"\*([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\*"
TIMESTAMP_LONG = r"\*([0-9]{1,3}:[0-9]{2}(?::[0-9]{2})?)\*"
SPEAKER_CLUE = (
    r"(?iuU)(меня зовут|мне зовут|я —|привет,?\s*я\b|расскажи про себя|расскажите про себя|представь(?:ся| себя)?|"
    r"у нас в гостях|сегодня с нами|в гостях у нас|спасибо,?\s+\w|"
    r"Speaker\s+\d+|^\s*[\wА-Яа-я][^:\n]{0,60}:)"
)

#: Caption files.
VTT_TIMING = r"(\d{2}:\d{2}:\d{2}\.\d{3}|\d{2}:\d{2}\.\d{3})\s+-->\s+(?:\d{2}:\d{2}:\d{2}\.\d{3}|\d{2}:\d{2}\.\d{3})"
VTT_SKIPPED = ("Kind:", "Language:", "NOTE", "STYLE")
SUBTITLE_LANGUAGE = r"(?i)\.([a-z]{2}(?:-[A-Za-z0-9]+)?)(?:-orig)?\.vtt$"

#: Titles and names.
TAG = r"<[^>]+>"
HEADING_1 = r"(?U)^\s*#\s+(.+?)\s*$"
TITLE_TIMESTAMPS = r"(?U)^(?:\*?\d{1,2}:\d{2}(?::\d{2})?\*?\s+)+"
TITLE_SPEAKER = r"(?iuU)^(?:\*\*)?speaker\s+\d+(?:\*\*)?\s*:?\s*"
GENERIC_STEM = r"(?iu)^(?:transcript|notes|summary|audio|video|recording|source|meeting|lecture)$"
#: Titles of four letters and names of two that are no generic word, `Speaker N`, number or time.
INFORMATIVE_TITLE = r"(?isuU)^(?!(?:transcript|notes|summary|audio|video|recording|source|meeting|lecture)$)(?!speaker\s+\d+$)(?![\d\s:._-]+$).{4}"
INFORMATIVE_PERSON = r"(?isuU)^(?!(?:author|creator|uploader|channel)$)(?!speaker\s+\d+$)(?![\d\s:._/\-]+$).{2}"
PLACEHOLDER = r"(?iuU)^(?:|[—–-]|unknown|speaker|author|creator|uploader|speaker\s+\d+)$"
DASHES = ("—", "-", "–")
VIDEO_ID = r"(?:youtube\.com/watch\?(?:.*?&)?v=|youtu\.be/|youtube\.com/shorts/|youtube\.com/live/|youtube\.com/embed/)([A-Za-z0-9_-]{11})"
PERSON = r"(?U)\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}|[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){1,2})\b"

#: Topics.
TOKEN = r"[A-Za-zА-Яа-яЁё0-9]+"
LONG_TOKEN = r"[A-Za-zА-Яа-яЁё0-9]{4,}"
TOPIC_STOP_WORDS = ("этого", "этими", "почему", "через", "когда", "после", "теория", "вопрос", "совет", "автора")
TOPIC_FALLBACK = "Ключевая идея проходит через несколько частей конспекта."

#: Summaries and checklists.
SUMMARY_LINE = r"(?U)^\s*(?:\d+[.)]|[-*])\s+(.+?)\s*$"
CHECKLIST_LINE = r"(?U)^\s*-\s+\[[ xX]\]\s+(.+?)\s*$"

#: Actions.
ACTION_PREFIX_MARKERS = ("вопрос", "метод", "совет", "критерий", "практик", "диагност", "вывод", "предупреждение")
IMPERATIVES = ("сделай", "проверь", "зафиксируй", "запиши", "определи", "выбери", "сравни", "найди", "ответь", "сформулируй", "вернись", "ограничь", "убери", "избегай", "попробуй", "скажи", "спроси", "не")
ACTION_VERB = r"(?iuU)^(?:сделай|проверь|зафиксируй|запиши|определи|выбери|сравни|найди|ответь|сформулируй|вернись|ограничь|убери|избегай|попробуй|скажи|спроси|не\b)"
IMPERATIVE_PREFIXES = (
    ("перв", "Зафиксируй "),
    ("вопрос", "Ответь себе на вопрос: "),
    ("мысл", "Запиши мысль: "),
    ("страх", "Проверь страх: "),
    ("роль", "Определи роль: "),
    ("блокир", "Найди блокирующую мысль: "),
)
STRONG_ACTION = (
    "сегодня", "завтра", "прямо сейчас", "немедлен", "сделай", "проверь", "зафиксируй", "запиши",
    "определи", "выбери", "ответь", "найди", "сформулируй", "вернись", "ограничь", "убери",
    "избегай", "попробуй", "зафиксир", "представь", "скажи себе", "сделать", "делать только это",
    "не сопротивля", "не бойся", "чернов", "первую мысль",
)
WEAK_ACTION = ("вопрос", "упражнен", "метод", "практик", "начать", "действовать", "действуй", "вспомни", "живого контакта", "не пуг", "возвращ")
NO_ACTION = ("соответствует понятию", "нейробиологический факт", "не метафора", "моделирование", "механическая система", "теория", "опровергнута исследованиями", "диагностический инструмент")
IMMEDIATE_WORDS = ("сегодня", "завтра", "прямо сейчас", "немедлен", "чернов", "зафиксир", "скажи себе", "представь", "сделать", "делать только это")
IMMEDIATE_STARTS = ("сделай", "проверь", "зафиксируй", "запиши", "определи", "выбери", "ответь", "найди", "сформулируй")
ONGOING_WORDS = ("не сопротивля", "не бойся", "не пуг", "живого контакта", "возвращ", "не смиря")
ONGOING_STARTS = ("не ", "избегай", "вернись")

#: Notes.
HEADER_LABELS = ("Автор", "Формат", "Тема", "Длительность", "Источник")
AUTHOR_FRAME = "Главная рамка автора"
FORMAT_LABELS = {"monologue": "лекция", "conversation": "интервью", "workshop": "воркшоп"}
FORMAT_LABEL_ELSE = "разбор"
CASE_PREFIX = "Кейс: "
AUTHOR_CONTEXT = "YouTube-автор / вероятный основной спикер"
CANDIDATE_CONTEXT = "Имя из metadata источника"

#: Files.
TEXT_EXTENSIONS = (".md", ".txt")
AUDIO_EXTENSIONS = (".m4a", ".mp3", ".wav", ".ogg", ".opus")
VIDEO_EXTENSIONS = (".webm", ".mp4", ".mkv", ".mov", ".avi")

#: Duration tiers in minutes: (from, blocks per 10 minutes, words per minute).
DENSITY_TIERS = ((150, 0.85, 24), (90, 0.75, 20), (45, 0.6, 15), (20, 0.5, 11))
#: Take-away bounds by content mode: (test, minutes, lowest, highest), the first that holds; then the rest.
TLDR_TIERS = {
    "monologue": (("<=", 18, 5, 6), ("<=", 35, 6, 8), (">=", 150, 12, 16), (">=", 90, 10, 14)),
    "conversation": (("<=", 30, 6, 8), (">=", 150, 12, 16), (">=", 90, 10, 14)),
    "workshop": ((">=", 150, 13, 18), (">=", 90, 11, 15), ("<=", 35, 7, 9)),
}
TLDR_ELSE = {"conversation": (7, 10), "workshop": (8, 12)}
TLDR_MONOLOGUE_ELSE = ((7, 9), (8, 10))
#: Smallest number of blocks of a chunk: (blocks, minutes, lines, tokens), any of which suffices.
BLOCK_TIERS = ((4, 32, 1200, 8000), (3, 18, 650, 4200), (2, 10, 350, 2200))

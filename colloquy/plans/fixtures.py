"""Texts that queries deal to the rows of the driver's tables, where rules need particular ones."""

TIMES = ("00:00", "12:34", "1:02:03", "99:59", "00:01:02.500", "01:02.250", "7", "3.25", "x", "1:2:3:4", "a:b", "", "10:xx")
URLS = (
    "https://www.youtube.com/watch?v=dQw4w9WgXcQ",
    "https://www.youtube.com/watch?list=PL1&v=abcdefghijk&t=3",
    "https://youtu.be/ABCDEFGHIJ_?t=1",
    "https://youtube.com/shorts/12345678901",
    "https://youtube.com/live/-_345678901",
    "https://youtube.com/embed/zzzzzzzzzzz",
    "https://example.com/talk.mp3",
    "/data/lecture.MP4",
    "/data/lecture.md",
    "https://youtube.com/about",
)
NAMES = ("Speaker 12", "@maria", "Иван Петров", "—", "unknown", "Author", "- Anna | ", "12:30", "dQw4w9WgXcQ-deep_learning-intro", "deep-learning-intro", "Speaker 1; Алекс Хармози", "—; Notion, Miro|Figma", "a", "**bold** name", "# Heading title", "lecture", "2024-01-02-abcdef12", "talk-0123456789ab")
ACTION_TEXTS = (
    "Сегодня запиши первую мысль.",
    "Вопрос: «Что мешает начать?»",
    "**Совет:** не бойся чернового варианта",
    "— Страх провала блокирует действие",
    "Метод: проверь гипотезу завтра *(12:30)*",
    "Нейробиологический факт о сне",
    "Роль наблюдателя помогает вспомнить упражнение",
    "не сопротивляйся, возвращайся к дыханию",
    "Избегай спешки и сделай паузу",
    "",
    "Первый шаг важнее плана",
    "Мысль приходит прямо сейчас: скажи себе «да»",
)

"""The tables' schemas, as DDL."""

LINES = "doc_id string, line_no int, text string"
CUES = "doc_id string, cue_no int, start_s double, text string"
SEGMENTS = "doc_id string, seg_no int, start_s double, speaker string, text string"
UTTERANCES = "doc_id string, utt_no int, speaker string, text string, ts string"
FILE_META = "doc_id string, lines long, bytes long, estimated_tokens long, markers long, dialogue_cues long, dialogue_speakers long, intro_cues long, clues array<string>, duration_estimate string"
CHUNK_PLAN = "doc_id string, chunk_id string, context_start int, context_end int, extraction_start int, extraction_end int, read_start int, read_end int, chunk_size int, overlap int, estimated_tokens long, approx_duration_seconds long, min_blocks int, chunk_fingerprint string, target_lines int, content_mode string"
CHAPTERS = "doc_id string, chapter_no int, timestamp string, title string, seconds int"
SOURCE_HINTS = "doc_id string, source_kind string, author_hint string, speaker_candidates array<string>, youtube struct<video_id:string,channel:string,channel_id:string,uploader:string,uploader_id:string,creator:string>, duration_seconds double"
BLOCKS = "work_id string, chunk_id string, block_no int, ts_start string, ts_end string, topic string, body string"
#: The columns of all manifest generations; a file has some of them.
MANIFEST_COLUMNS = (
    "block_file", "timestamp_start", "timestamp_end", "topic", "primary_claim", "names", "resources", "case_title",
    "has_dialogue", "quote_text", "action_now", "action_check", "action_avoid", "quotes_count", "cases",
)
MANIFEST_ALIASES = {"topic": ("topic", "title"), "timestamp_start": ("timestamp_start", "start_time", "ts_start"), "timestamp_end": ("timestamp_end", "end_time", "ts_end")}
MANIFEST = "work_id string, chunk_id string, row_no int, " + ", ".join(f"{c} string" for c in MANIFEST_COLUMNS)
SUMMARY_POINTS = "work_id string, chunk_id string, pos int, point string"
SPEAKER_MAP = "work_id string, pattern string, replacement string"
SENTINELS = "work_id string, stage string, chunk_id string, fingerprint string, outputs array<string>, completed_at timestamp"
TRACE = "ts timestamp, event string, run_id string, note_id string, stage string, duration_ms long, props string"
RUNS = "run_id string, note_id string, finished_at timestamp, hashes struct<transcript:string,markdown:string,html:string>, quality string, delivery string"
BATCH_RESULTS = "file string, status string, error string, title string, html string"

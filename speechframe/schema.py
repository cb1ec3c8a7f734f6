"""Logical tables as Spark schemas, and the default parameters of the operators."""

from __future__ import annotations

SEGMENTS = "meeting_id string, seq int, start double, end double, text string"
TURNS = "meeting_id string, turn_idx long, start double, end double, speaker string"
MANIFEST = "stem string, started_at string, samplerate int, parts array<string>, status string, devices map<string,string>, claude_model string, profile string, asr_engine string"

# Defaults that results depend on.
#: Ends of the files that stand beside an enrolled recording: request, result, mark of a change meanwhile.
ENROLL_SUFFIXES = (".request.json", ".result.json", ".changed.json")
CHARS_PER_TOKEN = 1.1
MERGE_MAX_TOKENS = 600
CHUNK_MAX_TOKENS = 15000
CHUNK_OVERLAP_TOKENS = 1500
SINGLE_CALL_THRESHOLD = 20000
MATCH_HIGH, MATCH_LOW = 0.62, 0.58
MIN_SPEAKING_SECONDS = 10.0
SAMPLES_PER_SPEAKER = 10
NAME_LENGTH = 60
MIN_INTERVAL_SECONDS, TARGET_SECONDS, MAX_INTERVALS = 1.5, 20.0, 12
SAMPLE_LINES = 3
LATE_ARRIVAL_SHARE = 0.25
HOTWORD_CHARS = 600
TAIL_LINES, KEEP_LINES = 200, 2000
MTIME_TOLERANCE_SECONDS = 2.0
ROTATE_SECONDS = 1800
VAD_SPAN_SECONDS = 28.0
MIN_SAFE_LENGTH, CONTEXT_CHARS, EXAMPLES_PER_TERM = 4, 25, 2
CLIP_SECONDS = 12.0
MIC_OK_DB, MIC_WARN_DB, LOOPBACK_OK_DB = -30.0, -45.0, -50.0
PARAM_CHARS = 512
MIN_PART_BYTES = 100

AUDIO_EXTENSIONS = ("mp3", "m4a", "wav", "ogg")
PROFILES, DEFAULT_PROFILE = ("dev", "cross"), "dev"
NO_SUMMARY_MODEL = "transcript-only"
UNKNOWN_SPEAKER = "SPEAKER_UNKNOWN"
SPEAKER_PREFIX = "ผู้พูด"
PARTICIPANTS_PREFIX = "ผู้เข้าร่วม:"
PROFILE_PREFIX = "ประเภทประชุม:"
TRANSCRIPT_TITLE = "# Transcript"
DIARIZATION_FAILED_NOTE = '> ⚠️ ไม่สามารถแยกผู้พูดได้อัตโนมัติ ข้อความทั้งหมดจึงแสดงเป็น "ผู้พูด 1" เพียงคนเดียว'
QUALITY_HEADINGS = ("## คำที่น่าจะถอดเพี้ยน", "## จุดที่ควรตรวจเอง")
QUALITY_TAGS = ("[คำเพี้ยน?]", "[ไม่มั่นใจ]")
TIMELINE_QUALITY_HEADING = "## ป้ายคุณภาพที่ค้างอยู่ในไทม์ไลน์รายช่วง"
SPEAKER_TABLE_HEAD = ("## ผู้พูดใน transcript", "", "| ป้าย | บรรทัด | ผลัด | อักขระ | สัดส่วน | ครั้งแรก | ครั้งสุดท้าย |", "|---|---:|---:|---:|---:|---:|---:|")
GPU_CODES = ("queued", "transcribe_started", "diarize_started")
RELEASE_CODES = ("summarize_started", "meeting_done", "job_failed")
STAGES = {"encode_started": 0, "queued": 1, "transcribe_started": 1, "diarize_started": 2, "summarize_started": 3, "summarize_progress": 3, "meeting_done": 4}
DICTIONARY_SECTIONS = ("exact", "fuzzy", "project-names", "aliases")
REPLACING_SECTIONS = ("exact", "aliases")
#: Head of a transcript block: bold speaker, time in brackets, colon.
HEADER = r"\*\*([^*]+)\*\*\s*\[(\d+:\d{2})\]:"

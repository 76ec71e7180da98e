"""Texts that are shown: labels of the status, fallbacks, and messages of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jstext

# Statuses, their labels, and the texts of messages.
STATUSES = ["idle", "capturing", "transcribing", "answering", "error"]
LABELS = {"capturing": "Listening", "answering": "Answering", "error": "Error"}
STOPPED, OTHER = "Stopped", "Starting"
WAITING = "Waiting for speech..."
NOT_SUPPORTED = "System audio capture is not supported on this device/session."
NOT_ALLOWED = "Screen/audio capture permission was denied."
UNKNOWN_START = "Unknown start error"
FALLBACKS = {
    "start": ("Start failed: ", UNKNOWN_START),
    "stop": ("Stop failed: ", "Unable to stop capture"),
    "load": ("Failed to load settings: ", "unknown error"),
    "save": ("Save failed: ", "unknown error"),
    "stt": ("STT error: ", "Deepgram stream error"),
}
CONNECTED = "STT connected. Waiting for speech..."
FIRST_SOUND = "Audio stream detected in main process..."
FIRST_SENT = "Audio stream detected. Transcribing..."


def status_label(running: Column, status: Column) -> Column:
    """What the status line shows."""
    shown = F.when(~F.coalesce(running, F.lit(False)), STOPPED)
    for s, label in LABELS.items():
        shown = shown.when(status == s, label)
    return shown.otherwise(OTHER)


def button_label(running: Column) -> Column:
    return F.when(F.coalesce(running, F.lit(False)), "Stop").otherwise("Start")


def transcript_shown(text: Column) -> Column:
    return F.coalesce(jstext.present(text), F.lit(WAITING))


def start_error(kind: Column, name: Column, message: Column) -> Column:
    """Of an error of a kind ('dom', 'error' or another) with its name and message, what a failed start says."""
    dom = F.when(name == "NotSupportedError", NOT_SUPPORTED).when(name == "NotAllowedError", NOT_ALLOWED).otherwise(F.concat(name, F.lit(": "), message))
    return F.when(kind == "dom", dom).when(kind == "error", message).otherwise(UNKNOWN_START)


def failure(action: str, message: Column) -> Column:
    """The prefix of an action and the error's message, or the action's own where there is none (null)."""
    prefix, fallback = FALLBACKS[action]
    return F.concat(F.lit(prefix), F.coalesce(message, F.lit(fallback)))

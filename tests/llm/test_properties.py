"""Laws of the Spark-free helpers on generated input."""

from hypothesis import assume, given, settings
from hypothesis import strategies as st

from sortline.llm import media, simhash

from . import brute

@settings(max_examples=100, deadline=None)
@given(st.text(max_size=3000))
def test_audio_is_lossless(text):
    payload = media.pad(text.encode("utf-8", "surrogatepass"))
    got = media.read(media.write(payload))
    assert got.data == payload and got.bad == got.skipped == 0 and got.checked == len(payload) // 192


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=600), st.binary(max_size=60))
def test_audio_reader_takes_any_bytes(junk, more):
    media.read(junk)
    assume(not junk.startswith(b"ID3"))  # a tag may span what follows
    payload = media.pad(more)
    got = media.read(junk.replace(b"\xff", b"\xfe") + media.write(payload)[len(b"ID3") :])
    assert got.data.endswith(payload)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB \n\té　c", max_size=120))
def test_fingerprints(text):
    assert simhash._fingerprint(text.encode(), 3) == brute.fingerprint(text)

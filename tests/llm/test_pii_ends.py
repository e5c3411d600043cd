
from plumbline.llm import pii


def test_pii_candidates_end_before_a_number_that_follows():
    text = "call 459-555-9246 10 am"
    assert ("phone", 5, 17) in pii.candidates(text)
    text = "card 4111.1111.1111.1111 22 left"
    assert ("card", 5, 24) in pii.candidates(text)
    assert ("email", 5, 28) in pii.candidates("MAIL ANNA AT EXAMPLE DOT ORG")

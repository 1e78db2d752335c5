"""Column functions: text normalisation, formats with validity, recognition in free text, confidences."""

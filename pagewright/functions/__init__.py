"""Column functions: text, metrics, answers, OCR output, layout, perturbations, images, markdown."""

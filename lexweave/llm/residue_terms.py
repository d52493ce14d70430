"""What placeholders, filler, error pages, script notices and refusals look like: fixed values, inspected in samples."""

import re

# Unfilled placeholders in the syntaxes of common template languages and of this memory's own masks.
PLACEHOLDER = re.compile(
    r"\{\{[^{}]{0,60}\}\}|\$\{[^{}]{0,60}\}|\{%[^{}]{0,60}%\}|<%[^<>]{0,60}%>|<\?[^<>]{0,60}\?>|\[\[[^\[\]]{0,60}\]\]|@@[^@\n]{1,60}@@|##[^#\n]{1,40}##"
    r"|(?<!\w)%[A-Za-z_][\w.]{1,40}%|__\s*[A-Z]{2,8}\s*\d+\s*__|⟦[^⟦⟧]{0,40}⟧|%\d{1,2}\$[sd]|(?<![\w%])%[sd](?!\w)|\{[A-Za-z_][\w.]{0,40}\}|\{\d{1,2}\}"
    r"|[<\[](?=[^<>\[\]]{3,40}[>\]])(?i:(?:[^\s<>\[\]]+ ){0,3}(?:your|insert|here|goes|votre|insérer|insertar|hier|einfügen|empresa|ihr|ihre|entreprise)\b(?: [^\s<>\[\]]+){0,3})[>\]]"
)

#: What every placeholder holds one of.
PLACEHOLDER_SIGN = re.compile(r"[{$<\[@#%_⟦]")

# Phrases of text that stands for nothing (lower case).
FILLER = (
    "sample copy, to be swapped before launch", "this paragraph only holds the space until the copy arrives", "your text goes here",
    "ce paragraphe réserve seulement la place", "texte d'exemple, à changer avant la mise en ligne", "este párrafo solo reserva el espacio",
    "texto de muestra, cambiar antes de publicar", "hier kommt später der richtige text hin", "dieser absatz ist nur ein muster und wird noch gefüllt",
    "blindtext, bitte vor dem start austauschen", "lorem ipsum", "votre texte ici", "su texto va aquí", "placeholder text", "dummy text",
)
# Phrases of error, quota and script notices (lower case).
NOTICES = (
    "you need a browser with scripting enabled to view this content", "this site needs scripts", "enable them and reload", "please turn on javascript to continue",
    "activez javascript pour afficher cette page", "ce contenu exige l'exécution de scripts", "active javascript para ver esta página", "este contenido requiere que los scripts estén permitidos",
    "bitte schalten sie javascript ein, um die seite zu sehen", "für diesen inhalt müssen skripte erlaubt sein",
    "internal server error - ticket", "service temporarily down for maintenance", "too many requests today, quota used up", "session expired, please sign in again",
    "the page you asked for could not be found", "fatal: call to undefined handler", "gateway problem", "no se ha encontrado la página", "página no encontrada", "seite nicht gefunden", "page not found", "the upstream server sent no valid answer", "language pair not accepted by this endpoint",
    "access denied", "your request was blocked", "rate limit", "page introuvable", "accès refusé", "le service est momentanément saturé", "acceso denegado",
    "servicio no disponible, inténtelo en", "zugriff verweigert", "diese seite gibt es nicht oder nicht mehr", "das tageskontingent ist aufgebraucht", "der dienst ist überlastet, bitte versuchen sie es",
    "<noscript>", "<html>", "<title>",
)
# Words of nonsense Latin; a run of them is filler.
LATIN = frozenset("lorem ipsum ipsumen dolor dolorat amet consecta consectetur adipisca adipiscing eiusma eiusmod tempora tempor incidun incididunt labore laborisa magna magnal aliqua aliquem veniat veniam nostrud exercita exercitation ullamc ullamco nisiut irure velitur velit cillumen cillum fugiata fugiat pariaturo pariatur sedun duisen commodus volupta voluptate sit elit sed ut et".split())

# Openings and phrases with which a service says that it can't or won't translate (lower case).
REFUSALS = (
    "not able to help with this text", "cannot provide a translation", "can't provide a translation", "won't be able to translate", "can't translate", "cannot translate", "unable to translate",
    "request cannot be fulfilled", "may breach the guidelines", "impossible de traiter cette demande", "je ne peux pas traduire", "impossible de traduire", "ne suis pas en mesure",
    "no me es posible ayudar", "no puedo traducir", "no es posible traducir", "kann ich nicht übersetzen", "darf ich diesen inhalt nicht bearbeiten", "ist mir eine übersetzung nicht möglich",
    "ne puis pas traduire", "no puedo ayudar", "als sprachassistent", "as an assistant i am not able", "as an ai", "kann diesen text nicht übersetzen", "could you share another text",
)
